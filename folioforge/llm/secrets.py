r"""Secret scans in DataFrame functions only: base patterns, and sliding-window entropy over candidate strings.

Places of matches: Spark has no function that gives them, so the text is cut at the matches, and running sums over the
lengths of what lies between and of the matches give starts and ends, in code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep_clear, let, spread, text_of

#: Fixed values of the base rules. The length bounds of access and hex change no match, as their runs are maximal.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "entropy")

#: Strings that the entropy rule looks at: whole runs of these characters, from + to z in ASCII.
_RUN = "A-Za-z0-9+/_="
WINDOW = 20
CANDIDATE = f"(?<![{_RUN}-])[{_RUN}-]{{{WINDOW},}}"
#: character class, pattern of the whole candidate, least entropy in bits a character of some window. First fit counts.
#: Of long words none seen has a window of over 3.82 bits, and most runs of 60 letters drawn at random have 3.92 or more.
CLASSES = (
    ("digits", "^[0-9]+$", 2.9),
    ("hex", "^[0-9a-fA-F]+$", 2.9),
    ("letters", "^[A-Za-z+/_=-]+$", 3.85),
    ("mixed", "^.", 3.7),
)
#: Candidates that the entropy rule passes over: those with the first pattern and without the second, if there is one.
#: No pattern repeats a group, as Java's matcher goes one call deeper for each repetition.
ALLOWED = (
    # Placeholders and counting, in strings of up to 80 characters; in longer ones they may stand by chance.
    (r"(?i)example|sample|placeholder|dummy|xxxx|changeme|your[_-]|0123456789|abcdefghij", ".{81}"),
    # Paths and names of ordinary words, and dates, telephone and card numbers.
    (r"^[A-Za-z][A-Za-z+/_=-]*$", "[A-Za-z]{16}"),
    (r"^[0-9][0-9+/_=-]*[+/_=-][0-9+/_=-]*$", "[0-9]{20}"),
    (r"^[-_=+/]+$", None),
)
#: Counts of a window's characters lie in words of PER_WORD counts, of BITS bits each.
_FIRST, _SLOTS, _PER_WORD, _BITS = ord("+"), ord("z") - ord("+") + 1, 12, 5
_CHUNK = 512


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array of longs, in chunks, so that appending costs little in long arrays."""
    zero = F.array(F.lit(0).cast("long"))
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def whole(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int")), lambda j: F.slice(v, j * _CHUNK + 1, F.lit(_CHUNK)))
        inner = F.transform(chunks, lambda c: F.aggregate(c, zero, grow))

        def shifted(parts: Column) -> Column:
            starts = F.aggregate(F.transform(parts, lambda p: F.element_at(p, -1)), zero, grow)
            return let(starts, lambda s: F.flatten(F.transform(parts, lambda p, j: F.transform(F.slice(p, 2, _CHUNK), lambda x: x + F.get(s, j)))))

        return let(inner, shifted)

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<bigint>")))


def located(text: Column, pattern: str, kind: int, kept: Callable[[Column], Column]) -> Column:
    """array<struct<start, kind, end, found>> of the kept matches of a pattern that matches no empty string."""
    length = lambda s: F.length(s).cast("long")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,found:string>>")

    def placed(found: Column) -> Column:
        # Each match with what stands before it: their running sums are the ends.
        reach = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, gap: length(m) + length(gap))
        spans = F.zip_with(running_sums(reach), found, lambda end, m: F.struct((end - length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("found")))
        return F.filter(spans, lambda s: kept(s["found"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def most_entropy(candidate: Column) -> Column:
    """The largest Shannon entropy, in bits a character, of WINDOW characters in a row; 0 for shorter strings.

    Counts move with the window: one character goes out and one comes in, which changes one count each, and the sum of
    count * log2(count) by two terms. A step costs the same whatever the string's length.
    """
    weights = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 1)))
    zeros = F.array(*[F.lit(0).cast("long")] * -(-_SLOTS // _PER_WORD))

    def slots(c: Column) -> Column:
        """Of each character the word of its count, and the count's place there."""
        slot = lambda x: F.ascii(x) - _FIRST
        return F.transform(F.slice(F.split(c, ""), F.lit(1), F.length(c)), lambda x: F.struct((slot(x) / _PER_WORD).cast("int").alias("word"), (slot(x) % _PER_WORD * _BITS).alias("shift")))

    def count(words: Column, at: Column) -> Column:
        return F.call_function("shiftright", F.get(words, at["word"]), at["shift"]).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

    def added(words: Column, at: Column, sign: int) -> Column:
        one = F.call_function("shiftleft", F.lit(sign).cast("long"), at["shift"])
        return F.transform(words, lambda w, k: F.when(k == at["word"], w + one).otherwise(w))

    def folded(at: Column) -> Column:
        start = F.struct(zeros.alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))

        def out(state: Column, i: Column) -> Column:
            goes = F.get(at, i - WINDOW)
            less = lambda n: F.struct(added(state["counts"], goes, -1).alias("counts"), (state["total"] - F.get(weights, n) + F.get(weights, n - 1)).alias("total"))
            return F.when(i >= WINDOW, let(count(state["counts"], goes), less)).otherwise(F.struct(state["counts"].alias("counts"), state["total"].alias("total")))

        def step(state: Column, i: Column) -> Column:
            def come(rest: Column) -> Column:
                comes = F.get(at, i)

                def more(n: Column) -> Column:
                    total = rest["total"] - F.get(weights, n) + F.get(weights, n + 1)
                    entropy = F.when(i >= WINDOW - 1, F.lit(math.log2(WINDOW)) - total / WINDOW).otherwise(F.lit(0.0))
                    return F.struct(added(rest["counts"], comes, 1).alias("counts"), total.alias("total"), F.greatest(state["best"], entropy).alias("best"))

                return let(count(rest["counts"], comes), more)

            return let(out(state, i), come)

        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), start, step, lambda s: s["best"])

    return F.when(F.length(candidate) >= WINDOW, let(slots(candidate), folded)).otherwise(F.lit(0.0))


def _is_dense(candidate: Column) -> Column:
    least = F.lit(99.0)
    for _, pattern, bits in reversed(CLASSES):
        least = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(least)
    allowed = F.lit(False)
    for pattern, but in ALLOWED:
        allowed = allowed | (candidate.rlike(pattern) & ~candidate.rlike(but) if but else candidate.rlike(pattern))
    # Sums of floats drift by less than this.
    return F.when(allowed, F.lit(False)).otherwise(most_entropy(candidate) >= least - 1e-9)


def secret_spans(text: Column) -> Column:
    """Struct of base and entropy spans, each sorted by start, then kind. An entropy span never overlaps a base one."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,found:string>>")
    assign = F.when(text.contains("=") | text.contains(":"), located(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, "^" + ASSIGN + "$", 2)) >= ASSIGN_LEAST)).otherwise(none)
    access = F.when(text.contains("AKIA"), located(text, ACCESS, 1, lambda m: F.lit(True))).otherwise(none)
    hexes = located(text, HEX, 2, lambda m: F.lit(True))
    base = F.sort_array(F.concat(assign, access, hexes))

    def with_entropy(b: Column) -> Column:
        # A candidate can only overlap base spans that start before it ends; few candidates are left to compare.
        free = F.filter(located(text, CANDIDATE, 3, _is_dense), lambda c: ~F.exists(b, lambda x: (x["start"] < c["end"]) & (x["end"] > c["start"])))
        return F.struct(b.alias("base"), free.alias("entropy"))

    return let(base, with_entropy)


def scan_secrets(docs: DataFrame, text: str = "text", keep_columns: list[str] | None = None) -> DataFrame:
    """keep_columns (default doc_id), and secrets: struct of arrays base and entropy of (start, kind, end, found).

    Starts and ends are code points, ends exclusive; kind is a place in KINDS. Null text counts as empty and has none.
    Repeated rows give repeated results, an empty table none; other columns of docs are not read. A kept column named
    secrets is renamed in_secrets.
    """
    keep = keep_columns or ["doc_id"]
    read = docs.select(*keep, text_of(text).alias("__text"))
    return keep_clear(read, ["secrets"]).withColumn("secrets", secret_spans(F.col("__text"))).drop("__text")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_secrets(text: Column, secrets: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by one mask."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))

    def step(s: Column, x: Column) -> Column:
        between = F.substring(text, (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        done = F.when(x["start"] >= s["at"], F.concat(s["done"], between, F.lit(mask))).otherwise(s["done"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), done.alias("done"))

    spans = F.sort_array(F.concat(secrets["base"], secrets["entropy"]))
    rest = lambda s: F.concat(s["done"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, state, step, rest))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spread(documents(spark, sf_dir)))
    base = F.col("secrets.base")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat(base, F.col("secrets.entropy")))).alias("spans"),
    )
