"""Column functions over text, names, lists, dates and numbers; no UDFs but the phonetic code and composed letters."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: File types by extension.
TYPE_GROUPS = {
    "Documents": ("pdf", "doc", "docx", "txt", "rtf", "odt"),
    "Spreadsheets": ("xls", "xlsx", "csv", "ods"),
    "Presentations": ("ppt", "pptx", "odp"),
    "Images": ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff", "svg"),
    "Videos": ("mp4", "avi", "mov", "mkv", "webm"),
    "Audio": ("mp3", "wav", "flac", "ogg", "m4a"),
    "Code": ("js", "ts", "py", "java", "cpp", "html", "css", "json", "sql"),
    "Archives": ("zip", "rar", "7z", "tar", "gz"),
}


def clean(text: Column) -> Column:
    """NUL and tabs become blanks, runs of white space one blank, ends trimmed."""
    t = F.regexp_replace(F.replace(text, F.lit("\0"), F.lit(" ")), r"[\t\x0B\f\r]+", " ")
    return F.trim(F.regexp_replace(t, r"[ \n]{2,}", " "))


def strip_control(text: Column) -> Column:
    """Without control characters but line ends."""
    return F.regexp_replace(text, r"[\x00-\x09\x0B\x0C\x0E-\x1F\x7F]", "")


def light_clean(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\t", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, " {2,}", " "), r"\n{3,}", "\n\n"))


def split_words(text: Column, least: int = 2, most: int = 50) -> Column:
    return F.slice(F.filter(F.split(text, r"[\s,.;:!?()\[\]{}\"'/|-]+"), lambda w: F.length(w) >= least), 1, most)


def preview(text: Column, n: int = 100) -> Column:
    """Cut at n; back to the last blank if that lies beyond 70 %."""
    cut = F.substring(text, 1, n)
    blank = F.lit(n) - F.instr(F.reverse(cut), " ")
    cut = F.when((F.instr(cut, " ") > 0) & (blank > int(0.7 * n)), F.substring(cut, F.lit(1), blank)).otherwise(cut)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit("...")))


def parts(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def normal_text(text: Column, most: int | None = None) -> Column:
    """Without NUL, runs of white space as one blank, trimmed, cut at ``most`` code points. For composed letters see ``composed``."""
    t = F.trim(F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("")), r"[ \t\r\n]+", " "))
    return t if most is None else F.substring(t, 1, most)


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Unicode's composed form (NFC); null for null."""
    return pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in texts], dtype=object)


#: How many characters of a file's metadata are kept, and how many words of how many characters.
METADATA_LIMITS = {"name": 255, "category": 100, "subject": 200, "summary": 1_000, "type": 100, "model": 100, "fileExtension": 20}
LIST_LIMITS = {"tags": 15, "keywords": 15, "keyEntities": 20}


def limited_metadata(values: dict[str, Column]) -> dict[str, Column]:
    """Metadata by name, within its limits: texts made normal and cut, lists of distinct words of 50 characters; other names as they are."""
    cut = lambda words: F.transform(words, lambda w: F.substring(F.trim(w), 1, 50))
    out = {}
    for name, c in values.items():
        if name in METADATA_LIMITS:
            c = normal_text(c, METADATA_LIMITS[name])
        elif name in LIST_LIMITS:
            c = distinct_keywords(cut(c), LIST_LIMITS[name])
        out[name] = c
    return out


def case_convention(text: Column, kind: str) -> Column:
    """A name's words by a convention: kebab, snake, camel, pascal, lower or upper; as it is for another one."""
    spaced = F.array_join(parts(text), " ")
    return {"kebab": kebab(text), "snake": snake(text), "camel": camel(text), "pascal": pascal(text), "lower": spaced, "upper": F.upper(spaced)}.get(kind, text)


def base_name(path: Column) -> Column:
    """What stands after the last slash or back slash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension_of(name: Column) -> Column:
    """The lower-cased extension with its dot; '' without one, or if the name begins with its only dot."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def fitted_name(name: Column, most: int = 255, *, unnamed: str = "unnamed") -> Column:
    """A file's name within ``most`` characters: its stem is cut, at its last blank, dash or underline beyond the half; a blank name gets one."""
    name = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(unnamed))
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    room = F.lit(most) - F.length(ext) - 1
    cut = F.substring(name, F.lit(1), F.least(room, F.length(name) - F.length(ext)))
    at = F.length(F.regexp_extract(cut, r"(?s)^(.*)[ _-][^ _-]*$", 1))
    stem = F.trim(F.when(at > room * 0.5, F.substring(cut, F.lit(1), at)).otherwise(cut))
    return F.when(F.length(name) <= most, name).when(room < 10, F.substring(name, 1, most)).otherwise(F.concat(stem, ext))


#: Date formats of file names.
DATE_FORMATS = {"YYYY-MM-DD": "yyyy-MM-dd", "MM-DD-YYYY": "MM-dd-yyyy", "DD-MM-YYYY": "dd-MM-yyyy", "YYYYMMDD": "yyyyMMdd"}


def formatted_date(ts: Column, style: Column) -> Column:
    """A time's day by one of DATE_FORMATS; an unknown style is the first of them."""
    out = F.date_format(ts, "yyyy-MM-dd")
    for name, pattern in DATE_FORMATS.items():
        out = F.when(style == name, F.date_format(ts, pattern)).otherwise(out)
    return out


def effective_date(name: Column, *times: Column) -> Column:
    """The date in a file's name (with dashes, else eight digits) if it is one, else the first of these times that is set."""
    dashed = F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    plain = F.regexp_replace(F.nullif(F.regexp_extract(name, r"(\d{8})", 1), F.lit("")), r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    return F.coalesce(F.try_to_timestamp(F.coalesce(dashed, plain)), *times)


def without_date(subject: Column) -> Column:
    """A subject without the dates at its end and what joins them to it; as it is if nothing else would be left."""
    short = F.regexp_replace(subject, r"(?:[\s_-]*(?:\d{4}-\d{2}-\d{2}|\d{2}-\d{2}-\d{4}|(?:19|20)\d{6}))+\s*$", "")
    return F.when(F.trim(short) == "", subject).otherwise(short)


def json_text(text: Column) -> Column:
    """The text as a JSON string, in quotes."""
    listed = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def validated_analysis(json: Column) -> Column:
    """(category, keywords, confidence) of a model's answer: only strings count as such, and only numbers from 0 to 100 as confidence.

    The category is ``document`` if there is none, keywords are the strings that are not blank,
    and the confidence is 70 if it is out of range or no number. What does not parse says nothing.
    """
    v = F.try_parse_json(json)
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit(""))
    part = lambda path: F.try_variant_get(v, path, "variant")
    string = lambda x: F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string"))
    number = F.when(kind(part("$.confidence")).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$.confidence", "double"))
    words = F.transform(F.coalesce(F.try_variant_get(v, "$.keywords", "array<variant>"), F.array().cast("array<variant>")), string)
    return F.struct(
        F.coalesce(F.nullif(F.trim(string(part("$.category"))), F.lit("")), F.lit("document")).alias("category"),
        F.filter(words, lambda w: w.isNotNull() & (F.trim(w) != "")).alias("keywords"),
        F.when(number.between(0, 100), number).otherwise(70.0).alias("confidence"),
    )


#: Extensions that are worked on, by kind.
EXTENSION_SETS = {
    "image": ("jpg", "jpeg", "png", "gif", "bmp", "webp", "svg", "tiff", "ico", "heic"),
    "document": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "md", "rtf", "csv", "json", "xml", "yml", "yaml", "html", "css", "js", "ts", "sql", "py", "java", "c", "cpp", "h", "rb", "go", "rs", "php", "odt", "ods", "odp", "epub", "eml", "msg", "kml", "kmz", "sh", "bat", "ps1"),
    "text": ("txt", "md", "rtf", "json", "csv", "xml", "yml", "yaml", "html", "css", "js", "ts", "sql", "py", "java", "c", "cpp", "h", "rb", "go", "rs", "php", "sh", "bat", "ps1", "ini", "log"),
    "audio": ("mp3", "wav", "ogg", "m4a", "flac", "aac"),
    "video": ("mp4", "mkv", "avi", "mov", "wmv", "webm"),
    "archive": ("zip", "rar", "7z", "tar", "gz", "bz2"),
    "3d": ("stl", "obj", "3mf", "scad", "gcode"),
    "design": ("ai", "eps", "psd"),
}


def is_supported(ext: Column, *kinds: str) -> Column:
    """Whether an extension, with or without its dot, is of one of these kinds; of ``analysed`` ones (text, document, image, archive) or ``all``."""
    named = {"analysed": ("text", "document", "image", "archive"), "all": tuple(EXTENSION_SETS)}
    wanted = sorted({e for k in kinds for n in named.get(k, (k,)) for e in EXTENSION_SETS[n]})
    return F.coalesce(F.regexp_replace(F.lower(ext), r"^\.", "").isin(*wanted), F.lit(False))


def titled(words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))


def kebab(text: Column) -> Column:
    return F.array_join(parts(text), "-")


def snake(text: Column) -> Column:
    return F.array_join(parts(text), "_")


def pascal(text: Column) -> Column:
    return F.array_join(titled(parts(text)), "")


def camel(text: Column) -> Column:
    p = pascal(text)
    return F.concat(F.lower(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))


def type_group(ext: Column) -> Column:
    out = F.lit("Files")
    for name, exts in TYPE_GROUPS.items():
        out = F.when(F.lower(ext).isin(*exts), name).otherwise(out)
    return out


def as_list(text: Column) -> Column:
    """A JSON array of strings, else a comma list; trimmed, without empties."""
    items = F.coalesce(F.from_json(text, "array<string>"), F.split(text, ","))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def distinct_keywords(words: Column, most: int = 15) -> Column:
    """Distinct whatever the case, in the form seen first. Words are made once, and not again for each that is kept."""
    once = lambda value, f: F.transform(F.array(value), f)[0]
    w = F.filter(F.transform(words, lambda x: F.trim(x)), lambda x: x != "")
    kept = lambda w, low: F.transform(F.slice(F.array_distinct(low), 1, most), lambda x: F.element_at(w, F.array_position(low, x).cast("int")))  # noqa: E731  # in the order of their first places
    return once(w, lambda w: once(F.transform(w, lambda x: F.lower(x)), lambda low: kept(w, low)))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.5)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    n = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def percent(x: Column) -> Column:
    """0..1 becomes 0..100; clamped and rounded."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(F.when(x <= 1, x * 100).otherwise(x))))


def backoff(n: Column, base: float = 5_000, most: float = 60_000) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), n - 1))


def version_key(v: Column) -> Column:
    return F.transform(F.split(v, r"\."), lambda x: x.cast("int"))


def error_kind(message: Column) -> Column:
    """The first of these signs that the message has; the order matters."""
    m = F.lower(message)
    out = F.lit("UNKNOWN")
    for sign, kind in reversed((("timeout", "TIMEOUT"), ("network", "NETWORK"), ("econn", "NETWORK"), ("not found", "NOT_FOUND"), ("permission", "PERMISSION"), ("model", "AI_ENGINE_ERROR"))):
        out = F.when(F.contains(m, F.lit(sign)), kind).otherwise(out)
    return out


def html_text(html: Column) -> Column:
    """Without scripts, styles and tags; six entities decoded in this order; white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def derived_confidence(explicit: Column, failed: Column, similarity: Column, signals: list[Column]) -> Column:
    """Percent: what the model says (0 without an error says nothing), else 30 to 70 by similarity, else 35 and 5 a signal."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(x)))
    said = explicit.isNotNull() & ~F.isnan(explicit) & ((explicit != 0) | F.coalesce(failed, F.lit(False)))
    near = F.when(similarity.between(0, 1), F.lit(30.0) + F.lit(40.0) * similarity).otherwise(F.least(F.lit(70.0), similarity))
    found = sum((F.coalesce(x, F.lit(False)).cast("int") for x in signals), F.lit(0))
    return F.when(said, clamp(F.when(explicit.between(0, 1), explicit * 100).otherwise(explicit))).when(similarity.isNotNull() & ~F.isnan(similarity), clamp(near)).otherwise(clamp(35.0 + 5 * found))


def with_concepts(text: Column, ext: Column, concepts: dict[str, list[str]]) -> Column:
    """The text with the concepts of the extension's kind behind it, those that it does not name yet."""
    by_ext = F.create_map(*(x for e, words in concepts.items() for x in (F.lit(e), F.array(*map(F.lit, words)))))
    new = F.filter(F.coalesce(F.try_element_at(by_ext, F.lower(ext)), F.array().cast("array<string>")), lambda w: ~F.contains(F.lower(text), F.lower(w)))
    return F.when(F.size(new) > 0, F.concat(text, F.lit(" "), F.array_join(new, " "))).otherwise(text)


def concept_score(concept: Column) -> Column:
    return F.least(F.lit(20), 10 + F.length(concept))


#: Naming templates by their parts.
NAME_TEMPLATES = {"subject-date": ("subject", "date"), "date-subject": ("date", "subject"), "project-subject-date": ("project", "subject", "date"), "category-subject": ("category", "subject")}


def suggested_name(template: Column, name: Column, values: dict[str, Column]) -> Column:
    """A file's name by a template's non-empty parts, with its extension; ``keep``, unknown templates or no part: as it is."""
    ext = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    out = name
    for key, parts in NAME_TEMPLATES.items():
        joined = F.concat_ws("-", *(F.nullif(F.trim(values.get(p, F.lit(None).cast("string"))), F.lit("")) for p in parts))
        out = F.when((template == key) & (joined != ""), F.concat(joined, ext)).otherwise(out)
    return out


def semantic_terms(text: Column, *, least: int = 4, stop: tuple[str, ...] = ("that", "this", "with", "from")) -> Column:
    """Distinct terms that say something, in order: long enough, not digits alone, no stop word."""
    ok = lambda w: (F.length(w) >= least) & ~w.rlike("^[0-9]+$") & ~w.isin(*stop)
    return F.sort_array(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), ok)))


def quoted(phrase: str) -> str:
    """The phrase as a pattern that matches it alone."""
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", phrase)


#: Names that watchers take for temporary, partial or system files.
TEMPORARY = (
    r"\.(tmp|temp)$", r"\.bak$", r"\.crdownload$", r"\.part$", r"\.partial$", r"\.download$", r"\.!qb$", r"\.swp$", r"\.swx$", r"\.swo$",
    r"\.lock$", r"\.lck$", r"^~\$", r"^\.#", r"^#.*#$", r"~$", r"^\._", r"^\.ds_store$", r"^thumbs\.db$", r"^desktop\.ini$",
)


def temporary_file(path: Column) -> Column:
    """Whether the last part of a path is the name of a temporary, partial or system file."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    return name.rlike("|".join(f"({x})" for x in TEMPORARY))


def any_phrase(text: Column, phrases: tuple[str, ...], most: int, *, at_start: bool = False) -> Column:
    """Whether a short text has one of the phrases, of whatever characters, with no letter or digit right beside it; or begins with one."""
    pattern = rf"{'^' if at_start else '(?<![a-z0-9_])'}({'|'.join(map(quoted, phrases))})(?![a-z0-9_])"
    return (F.length(text) <= most) & F.lower(F.trim(text)).rlike(pattern)


def summary_text(fields: list[Column], text: Column, *, snippet: int = 2_000, most: int = 4_000) -> Column:
    """Non-empty fields in order, a line each, then the first characters of the text."""
    lines = [F.nullif(F.trim(f), F.lit("")) for f in fields]
    return F.substring(F.concat_ws("\n", *lines, F.nullif(F.substring(text, 1, snippet), F.lit(""))), 1, most)


def phonetic(word: str) -> str:
    """First letter and three digits; equal codes are merged only when adjacent, any other letter parts them.

    The first letter's own code is not compared.
    """
    codes = {**dict.fromkeys("bfpv", "1"), **dict.fromkeys("cgjkqsxz", "2"), **dict.fromkeys("dt", "3"), "l": "4", **dict.fromkeys("mn", "5"), "r": "6"}
    word = "".join(c for c in word.lower() if "a" <= c <= "z")
    if not word:
        return ""
    out, last = [], ""
    for c in word[1:]:
        code = codes.get(c, "")
        if code and code != last:
            out.append(code)
        last = code
    return word[0].upper() + "".join(out)[:3].ljust(3, "0")


@F.pandas_udf(StringType())
def phonetic_code(words: pd.Series) -> pd.Series:
    return words.map(lambda w: phonetic(w or ""))
