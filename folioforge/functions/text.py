r"""Text functions as Column expressions. White space and digits follow Unicode, lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, equal to what existing manifests and chapters were made with.
#: The 29 code points that count as white space.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "St.", "Mt.", "No.", "vs.", "etc.", "e.g.", "i.e.", "U.S.", "U.K.")
ENDS, CLOSERS, SOFT_BREAKS = ".!?…。！？", "'\"”’)\\]", ",;:،，、؛"
DOT, DECIMAL = "<DOT>", "<DECIMAL>"
LANGUAGES = {
    "ar": "Arabic", "da": "Danish", "de": "German", "el": "Greek", "en": "English", "es": "Spanish", "fi": "Finnish",
    "fr": "French", "he": "Hebrew", "hi": "Hindi", "it": "Italian", "ja": "Japanese", "ko": "Korean", "ms": "Malay",
    "nl": "Dutch", "no": "Norwegian", "pl": "Polish", "pt": "Portuguese", "ru": "Russian", "sv": "Swedish", "sw": "Swahili",
    "tr": "Turkish", "zh": "Chinese",
}
TEXT_SUFFIXES, PDF_SUFFIXES = (".txt", ".text", ".md"), (".pdf",)

#: One sentence: a character, all up to a run of ends with closers after it, or the rest.
SENTENCE = rf"(?s).[^{ENDS}]*(?:[{ENDS}]+[{CLOSERS}]*|\z)"


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, held as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARACTERS))


def normalize(text: Column) -> Column:
    """Line feeds only, single spaces, stripped lines, no more than one blank line in a row."""
    single = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "[ \t]{2,}|\t", " ")
    lines = F.transform(F.split(single, "\n"), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(normalize(text), "\n\n"), strip), lambda p: p != "")


def protect(text: Column) -> Column:
    """Dots of abbreviations, in list order, then between digits, by placeholders."""
    for short in ABBREVIATIONS:
        text = F.replace(text, F.lit(short), F.lit(short.replace(".", DOT)))
    return F.regexp_replace(text, r"(?U)\.(?=\d)(?<=\d\.)", DECIMAL)


def restore(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(DOT), F.lit(".")), F.lit(DECIMAL), F.lit("."))


def sentences(paragraph: Column) -> Column:
    found = F.filter(F.transform(F.regexp_extract_all(protect(paragraph), F.lit(SENTENCE), 0), lambda s: strip(restore(s))), lambda s: s != "")
    return bind(found, lambda f: F.when(F.size(f) == 0, F.array(strip(paragraph))).otherwise(f))


def pack(units: Column, limit: int) -> Column:
    """Units joined by a space as long as limit allows; a unit that does not fit starts a new pack. Order is kept."""
    state = lambda done, cur, n: F.struct(done.alias("done"), cur.alias("cur"), n.alias("n"))
    start = state(F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(0))

    def step(s: Column, unit: Column) -> Column:
        longer = s["n"] + 1 + F.length(unit)
        first = F.when(s["cur"].isNull(), state(s["done"], unit, F.length(unit)))
        over = first.when(longer > limit, state(F.concat(s["done"], F.array(s["cur"])), unit, F.length(unit)))
        return over.otherwise(state(s["done"], F.concat(s["cur"], F.lit(" "), unit), longer))

    return F.aggregate(units, start, step, lambda s: F.when(s["cur"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))


def words(text: Column) -> Column:
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def split_dense(text: Column, limit: int) -> Column:
    """Packs of words; one long word is cut into slices, while a long word among others stays whole."""
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / limit).cast("int")), lambda i: F.substring(text, i * limit + 1, F.lit(limit)))
    long = bind(words(text), lambda w: F.when(F.size(w) == 1, slices).otherwise(pack(w, limit)))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(long)


def split_oversized(sentence: Column, limit: int) -> Column:
    """Packs of the parts between soft breaks; packs that are still too long are split as dense text."""
    parts = F.filter(F.transform(F.split(sentence, f"(?<=[{SOFT_BREAKS}]){WS}+"), strip), lambda p: p != "")
    packed = lambda p: F.flatten(F.transform(pack(p, limit), lambda x: split_dense(x, limit)))
    long = bind(parts, lambda p: F.when(F.size(p) == 1, split_dense(sentence, limit)).otherwise(packed(p)))
    return F.when(F.length(sentence) <= limit, F.array(sentence)).otherwise(long)


def chunks_of_paragraph(paragraph: Column, limit: int) -> Column:
    units = F.flatten(F.transform(sentences(paragraph), lambda s: split_oversized(s, limit)))
    return F.transform(pack(units, limit), strip)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def segment_id(chapter_number: Column, index: Column) -> Column:
    return F.format_string("chapter_%03d_segment_%04d", chapter_number, index)


def language_code(code: Column) -> Column:
    return F.lower(strip(code))


def supported_language(code: Column) -> Column:
    return language_code(code).isin(*LANGUAGES)


def sanitize_identifier(value: Column) -> Column:
    """Lower case, other characters than letters, digits, _ and - as one -; empty where nothing is left."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(value), "[^a-zA-Z0-9_-]+", "-"), r"^-+|-+\z", ""))


def source_kind(path: Column) -> Column:
    """text, pdf or null by suffix."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))
    return F.when(suffix.isin(*TEXT_SUFFIXES), "text").when(suffix.isin(*PDF_SUFFIXES), "pdf")


def output_path(kind: str, book_id: Column, chapter_number: Column, name: Column | None = None) -> Column:
    if kind == "manifest":
        return F.format_string("manifests/%s_chapter_%03d.json", book_id, chapter_number)
    if kind == "segment":
        return F.format_string("segments/%s/chapter_%03d/%s.wav", book_id, chapter_number, name)
    if kind == "chapter":
        return F.format_string("chapters/%s/%s_chapter_%03d.wav", book_id, book_id, chapter_number)
    if kind == "log":
        return F.format_string("logs/%s_chapter_%03d_%s.log", book_id, chapter_number, name)
    raise ValueError(f"unknown output kind {kind}")
