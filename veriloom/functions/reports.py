"""Column functions on what a report says of its rows: languages, disclosures, links, keys of files, reasons, titles and dates. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriloom.functions.text import provision_number
from veriloom.functions.titles import duration_seconds, listed_language

# The reading models of an OCR engine by language, and of economies whose laws have a language of their own.
READING_MODELS = {
    "English": "eng", "Bahasa Indonesia": "ind+eng", "Thai": "tha+eng", "Lao": "lao+eng", "Russian": "rus+eng", "Chinese": "chi_sim+eng",
    "Vietnamese": "vie+eng", "Kazakh": "kaz+eng", "Mongolian": "mon+eng", "Hindi": "hin+eng",
}
DEFAULT_MODEL = "eng"
ECONOMY_MODELS = {"MY": ("eng+msa", ["English", "Other"]), "TL": ("por+eng", ["Other"])}
LATIN_LANGUAGES = ["English", "Bahasa Indonesia", "Vietnamese", "Other"]
SECOND_READER = [*LATIN_LANGUAGES, "Chinese"]
# Disclosures that a document owes its rows.
MECHANICAL_NOTE = "law name mechanically derived from the document title (off-corpus document: a live crawl catch, not a curated corpus entry)"
MECHANICAL_MANUAL_NOTE = "law name mechanically derived from the document title (off-corpus document: added by a reviewer, not a curated corpus entry)"
MECHANICAL_PREPARED_NOTE = "law name mechanically derived from the document title (off-corpus document: fetched by Discovery when the Corpus was prepared, not a curated corpus entry)"
ANY_HOST_NOTE = "user-supplied document, host not on the Round 1 portal whitelist"
MANUAL_NOTE = "manually added by the reviewer (source kind manual): the Source URL was supplied by hand and is not an automated Portal catch"
FIXTURE_NOTE = "fixture legislation seeded from the install, demo only"
# The label of a machine's rendering, and what is said where there is none.
GLOSS_LABEL = "[AI translation, non-authoritative]"
GLOSS_UNAVAILABLE = f"{GLOSS_LABEL} not available: the translation lane produced no usable English for this quote. The Verbatim Snippet is the only authority."
# First bytes of files that are not read, and what they are; tags that open a web page.
SIGNATURES = [
    ("PK\x03\x04", "a Word, Excel or PowerPoint file, or a zip archive"), ("\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "an older Word or Excel file"),
    ("\x89PNG", "an image"), ("\xff\xd8\xff", "an image"), ("GIF8", "an image"), ("{\\rtf", "a rich-text (RTF) file"),
]
HTML_OPENERS = r"(?i)<(?:!doctype\s+html|html|head|body|meta|title|div|p|table|article|main|section)\b"
# Keys of uploaded files, prefixes of run ids.
UPLOAD_SCHEME, UPLOAD_MARKER = "local-upload", "#sha256="
RUN_PREFIXES = {"run": "run", "discovery": "disc"}
# Why a found file was not added.
SKIP_REASONS = {
    "in_corpus": "Already in the Corpus, so it was not asked for again.",
    "off_whitelist": "Its address is not on the Portal's list of official hosts, so it was not fetched.",
    "robots": "The Portal's robots.txt asks crawlers not to fetch it, so it was not fetched.",
    "http_error": "The Portal did not send the file.",
    "fetch_error": "The request for the file failed.",
    "duplicate": "The same file as another address already fetched, so it is kept once.",
    "unchanged": "Fetched again, and the file matches the Document already in the Corpus, so nothing changed.",
    "not_added": "Fetched, but its text could not be read, so it was not added.",
    "limit": "Not fetched: this Discovery was limited to fewer Documents.",
    "failed_before": "Failed on an earlier Discovery; not asked again.",
    "not_fetched": "Not fetched in this Discovery.",
}
SKIP_DETAILS = {
    "http_error": "The Portal answered %s, so nothing was saved.",
    "fetch_error": "The request for the file failed (%s), so nothing was saved.",
    "not_added": "Fetched, but its text could not be read (%s), so it was not added.",
}
# Months, statute headings, banners above them, and the phrases beside which a document states its date.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
LINE_SHAPE = r"^[A-Za-z][A-Za-z0-9 ,()'’./-]{5,119}$"
INSTRUMENT = r"(?i)\b(?:acts?|regulations?|code|akta|kanun|ordinance)\b"
YEAR_END = r"\b(?:1[89]\d\d|20\d\d)$"
BANNERS = ["the statutes of the republic of singapore", "laws of malaysia", "undang-undang malaysia"]
TITLE_LINES = 60
TEXT_DATE = r"(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{4})"
IN_FORCE = r"(?i)version\s+in\s+force\s+from\s+(\d{1,2})/(\d{1,2})/(\d{4})"
DATED = {
    "SG": [r"(?i)amendments\s+up\s+to\s+and\s+including\s+"],
    "MY": [r"(?is)pub\w{0,3}ication\s+in\s+the\D{0,60}?", r"(?is)Royal\W{1,5}Assent\D{0,60}?"],
    "AU": [r"(?i)Compilation\s+date:\s*"],
}
FRONT_MATTER = 3000


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _said(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def resolved_language(raw: Column, portal: Column) -> Column:
    """language, disclosed: the recorded language; else the portal's, if it has exactly one; else Other, to be disclosed."""
    known = F.when(_said(raw), listed_language(raw)).when(F.size(portal) == 1, listed_language(F.get(portal, F.lit(0))))
    return F.struct(F.coalesce(known, F.lit("Other")).alias("language"), known.isNull().alias("disclosed"))


def is_reviewed(reviewer: Column) -> Column:
    """Whether a person is named."""
    return F.coalesce(reviewer, F.lit("")).rlike(r"(?U)\S")


def shipped_english(drafted: Column, committed: Column, unavailable: str = GLOSS_UNAVAILABLE) -> Column:
    """english, reviewer: the run's rendering (struct of english, label, reviewed_by) under its label unless a person approved it,
    the notice where none could be drafted; without one the committed text."""
    text = F.trim(F.coalesce(drafted["english"], F.lit("")))
    approved = is_reviewed(drafted["reviewed_by"])
    told = F.when(text == "", F.lit(unavailable)).when(approved, text).otherwise(F.concat(drafted["label"], F.lit(" "), text))
    english = F.when(drafted.isNull(), F.coalesce(committed, F.lit(""))).otherwise(told)
    return F.struct(english.alias("english"), F.when(drafted.isNotNull() & (text != "") & approved, drafted["reviewed_by"]).alias("reviewer"))


def scan_flag(manual_review: Column, reason: Column, word_confidence: Column, dictionary_hit: Column) -> Column:
    """Why a scan's text needs a person; null where it doesn't."""
    share = lambda x: F.concat(F.bround(x * 100).cast("int").cast("string"), F.lit("%"))
    hit = F.coalesce(F.concat(F.lit(" and "), share(dictionary_hit), F.lit(" of words found in the dictionary")), F.lit(""))
    read = F.concat(F.lit("Read by OCR with "), share(word_confidence), F.lit(" word confidence"), hit)
    none = F.lit("Read by OCR with no reading model for its language, so the text needs a person to check it")
    return F.when(F.coalesce(manual_review, F.lit(False)), F.when(_said(reason), none).otherwise(read))


def reading_models(language: Column, economy: Column) -> Column:
    """The models an OCR engine reads a document with."""
    out = F.coalesce(_map(READING_MODELS)[language], F.lit(DEFAULT_MODEL))
    for code, (models, languages) in ECONOMY_MODELS.items():
        out = F.when((economy == code) & (language.isNull() | language.isin(*languages)), models).otherwise(out)
    return out


def ocr_policy(language: Column, economy: Column) -> Column:
    """dictionary_proxy, rapidocr_escalation, manual_review_reason of a document's language."""
    own = [(economy == code) & language.isin(*languages) for code, (_, languages) in ECONOMY_MODELS.items()]
    known = language.isNull() | language.isin(*READING_MODELS) | F.coalesce(own[0], F.lit(False)) | F.coalesce(own[1], F.lit(False))
    reason = F.concat(F.lit("no tesseract language data is vendored for Language '"), language, F.lit(f"', so the page was read as {DEFAULT_MODEL}: the text is not trustworthy without a human check"))
    among = lambda names: language.isNull() | language.isin(*names)
    return F.struct(among(LATIN_LANGUAGES).alias("dictionary_proxy"), among(SECOND_READER).alias("rapidocr_escalation"), F.when(~known, reason).alias("manual_review_reason"))


def fetched_before(fetched: Column, started: Column, hours: float = 12) -> Column:
    """Whether a document was fetched well before a run, so that it was prepared rather than caught in its pass."""
    return F.coalesce(duration_seconds(fetched, started) > hours * 3600, F.lit(False))


def disclosures(mechanical: Column, manual: Column, prepared: Column, any_host: Column, fixture: Column, note: Column) -> Column:
    """The notes of a document's rows, in order; the document's own comes last."""
    named = F.when(manual, MECHANICAL_MANUAL_NOTE).when(prepared, MECHANICAL_PREPARED_NOTE).otherwise(MECHANICAL_NOTE)
    told = [F.when(mechanical, named), F.when(any_host, ANY_HOST_NOTE), F.when(manual, MANUAL_NOTE), F.when(fixture, FIXTURE_NOTE), F.when(_said(note), note)]
    return F.array_compact(F.array(*told))


def source_link(document_id: Column, url: Column, format_: Column, location: Column, run: Column) -> Column:
    """href, kind, page: the official address with the cited page or anchor unless it has one, else the stored copy's."""
    where, address = F.coalesce(location, F.lit("")), F.trim(F.coalesce(url, F.lit("")))
    page = F.when(format_ == "pdf", F.regexp_extract(where, r"(?i)page\s+(\d+)", 1).try_cast("int"))
    anchor = F.when(format_ == "html", F.nullif(F.regexp_extract(where, r"#([^\s#]+)", 1), F.lit("")))
    at_page = F.concat(F.lit("#page="), page.cast("string"))
    place = F.when(F.contains(address, F.lit("#")), "").otherwise(F.coalesce(at_page, F.concat(F.lit("#"), anchor), F.lit("")))
    quoted = lambda x: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    of_run = F.when(_said(run), F.concat(F.lit("?run_id="), quoted(run))).otherwise("")
    stored = F.concat(F.lit("/api/documents/"), quoted(document_id), F.lit("/pdf"), of_run, F.coalesce(at_page, F.lit("")))
    official = address.rlike("^(?i)https?://")
    return F.struct(F.when(official, F.concat(address, place)).otherwise(stored).alias("href"), F.when(official, "official").otherwise("local").alias("kind"), page.alias("page"))


def manifest_key(url: Column, sha256: Column) -> Column:
    """The key of an uploaded file: its address and digest, or its digest alone."""
    return F.when(_said(url), F.concat(url, F.lit(UPLOAD_MARKER), sha256)).otherwise(F.concat(F.lit(f"{UPLOAD_SCHEME}:"), sha256))


def manifest_address(key: Column) -> Column:
    """The address in a manifest key; null where an upload had none."""
    address = F.regexp_extract(key, rf"(?s)^(.+){UPLOAD_MARKER}[0-9a-f]{{64}}\z", 1)
    return F.when(F.startswith(key, F.lit(f"{UPLOAD_SCHEME}:")), None).when(address != "", address).otherwise(key)


def readable_kind(content: Column) -> Column:
    """kind (pdf, html, text or null), problem (what a file is that can't be read)."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    what = F.coalesce(*[F.when(F.startswith(head, F.lit(first)), name) for first, name in SIGNATURES])
    html = F.regexp_replace(head, "^[\xef\xbb\xbf \t\r\n]+", "").rlike(HTML_OPENERS)
    plain = F.is_valid_utf8(content.cast("string")) & ~F.contains(content, F.lit(bytearray(1)))
    kind = F.when(F.contains(F.substring(head, 1, 1024), F.lit("%PDF-")), "pdf").when(what.isNotNull(), None).when(html, "html").when(plain, "text")
    return F.struct(kind.alias("kind"), F.when(kind.isNull(), F.coalesce(what, F.lit("not a PDF, a web page or plain text"))).alias("problem"))


def skip_reason(code: Column, detail: Column) -> Column:
    """Why a found file was not added, with the portal's answer where that is all there is to say."""
    out = _map(SKIP_REASONS)[code]
    for k, text in SKIP_DETAILS.items():
        out = F.when((code == k) & _said(detail), F.format_string(text, detail)).otherwise(out)
    return out


def register_key(title: Column) -> Column:
    """A title as registers are searched for it: exact, but for space, a final stop and a leading article."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(title, r"\s+", " ")), r"\.+$", "")
    return F.regexp_replace(F.lower(plain), r"^the\s+", "")


def run_id(kind: Column, opened: Column, salt: Column) -> Column:
    """A readable, sortable id; null for a kind that isn't known."""
    return F.concat(_map(RUN_PREFIXES)[kind], F.lit("_"), F.date_format(opened, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), F.substring(F.sha2(salt, 256), 1, 6))


def section_order(section: Column) -> Column:
    """Order of cited sections: by number, then by what follows it; those without a number last."""
    number = provision_number(section)
    major = F.regexp_extract(number, r"^(\d+)", 1).try_cast("decimal(38,0)")
    return F.struct(major.isNull().alias("last"), major.alias("major"), F.regexp_replace(number, r"^\d+", "").alias("rest"))


def only_difference(this: str, other: str, indicator: Column, cited: Column, title: Column) -> Column:
    """What is said of a provision that one side alone cites; cited and title are the other side's choice for the indicator, null
    where it found none or chose the same document."""
    line = F.lit(f"Only Engine {this} cited this provision; ")
    where = F.concat(cited, F.coalesce(F.concat(F.lit(" of "), title), F.lit("")))
    none = F.concat(F.lit(f"Engine {other} found no evidence for "), indicator)
    return F.concat(line, F.coalesce(F.concat(F.lit("for "), indicator, F.lit(f" Engine {other} cited "), where), none))


def is_bare_noise(title: Column) -> Column:
    """Whether the words after a bare number are a date, a table row or the end of a sentence rather than a heading."""
    return title.rlike("^(?:" + "|".join(MONTHS) + ")") | F.contains(title, F.lit("%")) | (F.endswith(title, F.lit(".")) & ~F.endswith(title, F.lit("etc.")))


def is_heading(text: Column) -> Column:
    """The name of a statute that a line holds, else null."""
    line = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), "^(?i)the ", "")
    words = F.split(F.regexp_replace(line, "[^A-Za-z0-9 ]+", " "), " ")
    content = F.exists(words, lambda w: (w != "") & ~w.rlike(r"^\d+$") & ~w.rlike(rf"^(?:{INSTRUMENT})$"))
    balanced = F.length(F.replace(line, F.lit("("))) == F.length(F.replace(line, F.lit(")")))
    return F.when(balanced & line.rlike(LINE_SHAPE) & line.rlike(INSTRUMENT) & line.rlike(YEAR_END) & content, line)


def heading_of(text: Column, most: int = TITLE_LINES) -> Column:
    """The first statute name on a document's first lines, of one to three lines joined."""
    lines = F.transform(F.slice(F.split(text, r"\r\n|[\n\r]"), 1, most), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))

    def joined(i: Column, width: int) -> Column:
        parts = F.slice(lines, i, width)
        fits = (F.size(parts) == width) & ~F.exists(parts, lambda p: (p == "") | F.lower(p).isin(*BANNERS))
        if width > 1:
            wrapped = ~F.exists(F.slice(parts, 1, width - 1), lambda p: p.rlike(r"[\d.:;]$"))
            fits = fits & wrapped & F.contains(F.get(parts, F.lit(0)), F.lit(" ")) & is_heading(F.get(parts, F.lit(width - 1))).isNull()
        return F.when(fits, is_heading(F.array_join(parts, " ")))

    found = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.coalesce(*[joined(i, w) for w in (1, 2, 3)]))
    return F.when(F.size(lines) > 0, F.get(F.array_compact(found), F.lit(0)))


def last_amended(text: Column, economy: Column) -> Column:
    """'Month YYYY' as a document's own front matter states its date; null where it doesn't."""
    head = F.substring(text, 1, FRONT_MATTER)

    def stated(label: str) -> Column:
        part = lambda k: F.regexp_extract(head, label + TEXT_DATE, k)
        return F.when(part(2) != "", F.concat(part(2), F.lit(" "), part(3)))

    month = F.regexp_extract(head, IN_FORCE, 2).try_cast("int")
    force = F.when(month.between(1, 12), F.concat(F.get(F.array(*map(F.lit, MONTHS)), month - 1), F.lit(" "), F.regexp_extract(head, IN_FORCE, 3)))
    out = F.lit(None).cast("string")
    for code, labels in DATED.items():
        out = F.when(economy == code, F.coalesce(*([force] if code == "SG" else []), *map(stated, labels))).otherwise(out)
    return out


def json_object(answer: Column) -> Column:
    """The JSON object in a model's answer: fenced, bare or among words; null where there is none."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n(.*?)```", 1)
    body = F.when(text.rlike(r"(?s)```(?:json)?\s*\n.*?```"), F.trim(fenced)).otherwise(text)
    return F.when(F.startswith(body, F.lit("{")), body).otherwise(F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit("")))


def parse_glosses(answer: Column) -> Column:
    """Entries (mapping_id, english) of a batched answer, the last of an id; none where it is malformed."""
    listed = F.try_variant_get(F.try_parse_json(json_object(answer)), "$.glosses", "array<variant>")
    text = lambda x, field: F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{field}", "variant")) == "STRING", F.try_variant_get(x, f"$.{field}", "string"))
    entries = F.transform(listed, lambda x: F.struct(text(x, "mapping_id").alias("mapping_id"), text(x, "english").alias("english")))
    whole = F.coalesce(F.filter(entries, lambda x: x["mapping_id"].isNotNull() & x["english"].isNotNull()), F.array().cast("array<struct<mapping_id:string,english:string>>"))
    return F.filter(whole, lambda x, i: ~F.exists(F.slice(whole, i + 2, F.greatest(F.size(whole), F.lit(1))), lambda y: y["mapping_id"] == x["mapping_id"]))
