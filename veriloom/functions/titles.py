"""Column functions on the names of laws and what a report says of them. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Economies that draft in Articles.
ARTICLE_ECONOMIES = ["CN", "ID", "LA", "VN", "KZ", "RU", "MN", "TL"]
# The languages a report may name, and other spellings of them.
LANGUAGES = ["English", "Thai", "Vietnamese", "Bahasa Indonesia", "Chinese", "Hindi", "Kazakh", "Russian", "Lao", "Mongolian", "Other"]
LANGUAGE_NAMES = {
    "indonesian": "Bahasa Indonesia", "bahasa": "Bahasa Indonesia", "bahasa indonesian": "Bahasa Indonesia", "mandarin": "Chinese", "chinese (simplified)": "Chinese",
    "simplified chinese": "Chinese", "viet": "Vietnamese", "tiếng việt": "Vietnamese", "laotian": "Lao", "kazakhstani": "Kazakh", "mongol": "Mongolian", "english (translation)": "English",
}
# Words that name a framework of an indicator's family.
FAMILIES = {
    "7.1": ["personal data", "privacy", "personal information", "data protection", "个人信息", "個人資料", "ข้อมูลส่วนบุคคล", "персональных данных", "персональные данные", "дербес деректер", "хувь хүний мэдээлэл", "хувийн мэдээлэл", "data pribadi", "data peribadi", "dữ liệu cá nhân", "thông tin cá nhân", "ຂໍ້ມູນສ່ວນບຸກຄົນ", "ປົກປ້ອງຂໍ້ມູນ"],
    "7.2": ["cyber", "siber", "network security", "information security", "critical infrastructure", "critical information infrastructure", "information technology act", "informasi dan transaksi elektronik", "网络安全", "網路安全", "ไซเบอร์", "кибер", "критической информационной инфраструктуры", "an ninh mạng", "an toàn thông tin", "ໄຊເບີ"],
}
# Headings and phrases of scope clauses, words and openings of subordinate instruments, ends of a title block.
SCOPE_HEADINGS = ["scope", "purpose", "objective", "objects", "目的", "适用范围", "tujuan", "ruang lingkup", "วัตถุประสงค์", "mục đích", "phạm vi", "цель", "ຈຸດປະສົງ", "ຂອບເຂດ"]
SCOPE_PHRASES = ["this act applies", "this act shall apply", "this law applies", "this law shall apply", "the purpose of this act", "the purposes of this act", "the objects of this act", "the object of this act", "the purpose of this law", "本法适用", "为了保护个人信息", "undang-undang ini berlaku", "akta ini terpakai", "พระราชบัญญัตินี้ใช้บังคับ", "настоящий федеральный закон регулирует"]
APPLICATION = r"\bapplication\b(?:\s+of\s+(?:this\s+)?(?:act|law|part|code|regulations?)\b|\s*$)"
SUBORDINATE_WORDS = ["amendment", "amending", "code of practice", "perubahan", "pindaan", "bill", "修正", "修改", "peraturan pemerintah", "peraturan menteri"]
SUBORDINATE_OPENING = r"^\s*(?:pp|permen\w*|regulations?|rules?|peraturan)\b"
BLOCK_END = r"dengan rahmat|menimbang|目\s*录|第一章|whereas|be it enacted|table of contents|arrangement of sections|contents\b"
BLOCK_CHARS = 600
# What stands between a page's name and its site's.
SITE_SEPARATOR = r"\s+[-|–—]\s+|\s*_\s*|\s*｜\s*"


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in words])


def drafting_label(label: Column, economy: Column) -> Column:
    """Sections are Articles where an economy drafts in them."""
    return F.when(F.upper(economy).isin(*ARTICLE_ECONOMIES), F.regexp_replace(label, r"(?<![A-Za-z])s\.\s*(?=\S)", "Art. ")).otherwise(label)


def location_reference(format_: Column, page: Column, path: Column) -> Column:
    """Where a quote is: the page of a PDF, the section path of a page without pages; empty where it isn't known."""
    html = F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("HTML: "), path)).otherwise("")
    return F.when(format_ == "html", html).when(page > 0, F.concat(F.lit("PDF: page "), page.cast("string"))).otherwise("")


def listed_language(raw: Column) -> Column:
    """The language as a report may name it; what it has no name for is Other."""
    known = {x.lower(): x for x in LANGUAGES} | LANGUAGE_NAMES
    return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.lower(F.trim(raw))], F.lit("Other"))


def title_block(head: Column) -> Column:
    """A document's opening without lines of a site's header, up to the enacting words, recitals or contents."""
    lines = F.split(F.substring(F.coalesce(head, F.lit("")), 1, BLOCK_CHARS), r"\r\n|[\n\r]")
    text = F.array_join(F.filter(lines, lambda x: ~x.rlike("[_|｜]")), "\n")
    return F.regexp_replace(text, rf"(?is)(?:{BLOCK_END}).*$", "")


def of_family(indicator: Column, text: Column) -> Column:
    """Whether a text names a framework of the indicator's family."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda rest, kv: F.when(indicator == kv[0], _any(low, kv[1])).otherwise(rest), FAMILIES.items(), F.lit(False))


def framework_tier(indicator: Column, law_name: Column, head: Column, cited: Column) -> Column:
    """0 by the title, 1 by the title block, 2 by a citation of the baseline, else null."""
    return F.when(of_family(indicator, law_name), 0).when(of_family(indicator, title_block(head)), 1).when(cited, 2)


def is_scope(section: Column, subsection: Column, quote: Column) -> Column:
    heading = F.lower(F.concat(F.coalesce(section, F.lit("")), F.lit(" "), F.coalesce(subsection, F.lit(""))))
    return _any(heading, SCOPE_HEADINGS) | heading.rlike(APPLICATION) | _any(F.lower(F.coalesce(quote, F.lit(""))), SCOPE_PHRASES)


def is_subordinate(law_name: Column, head: Column) -> Column:
    title = F.lower(F.coalesce(law_name, F.lit("")))
    return _any(title, SUBORDINATE_WORDS) | title.rlike(SUBORDINATE_OPENING) | _any(F.substring(F.lower(title_block(head)), 1, 200), SUBORDINATE_WORDS)


def strip_site_name(title: Column) -> Column:
    """A page's name without its site's, where the first part reads as a name: two words, or four Chinese characters."""
    parts = F.filter(F.transform(F.split(title, SITE_SEPARATOR), lambda x: F.trim(x)), lambda x: x != "")
    first = F.get(parts, F.lit(0))
    name = (F.regexp_count(first, F.lit(r"[㐀-鿿]")) >= 4) | first.rlike(r"\S\s+\S")
    return F.when((F.size(parts) >= 2) & name, first).otherwise(title)


def needs_ocr(low_pages: Column, pages: Column, most: float = 0.5) -> Column:
    """Whether most pages of a document yielded next to no text."""
    return F.coalesce((pages > 0) & (low_pages / pages > most), F.lit(False))


def reference_base(reference: Column) -> Column:
    """The number that a cited section begins with, or all of it."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(reference, r"^(\d+[A-Za-z]{0,3})", 1), F.lit("")), reference))


def duration_seconds(started: Column, ended: Column) -> Column:
    """Seconds between two ISO texts; null where one is missing or no time."""
    at = lambda x: F.try_to_timestamp(F.regexp_replace(x, "Z$", "+00:00"))
    return (F.unix_micros(at(ended)) - F.unix_micros(at(started))) / 1e6
