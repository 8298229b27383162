"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Only SQL functions. The patterns give the base spans. On top, every run of 20 or more token
characters with a letter and a digit is a candidate. Its character class (hex, alnum or base64) sets
the alphabet and the threshold. A window of 20 characters slides over it, with the count of each
character kept up to date: the one that enters and the one that leaves change the sum of n log2 n, from
which the entropy follows. The candidate is a secret if its best window reaches the threshold, unless
the allow-list knows it or it meets a base span.

The allow-list has two parts. A path is a candidate with a slash whose every segment is made of words
or numbers, so a random key with slashes, or one at the end of a path, is none. Identifiers, alphabets and
placeholders are cut out, and what is left of the candidate between them, slashes and equal signs
is judged piece by piece: it is a secret if a piece would be one.

The counts of a window (20 at most each) stand five bits wide in a few longs, so a step of the window
costs the same for any alphabet and candidate, and a candidate's cost grows with its length. Spans are gathered
in chunks of CHUNK matches, so many matches cost little more than few.

Spans are in code points, end exclusive.

Defined cases: null or empty text has no spans; matches never cross documents; repeated rows get
equal spans; an empty table gives an empty table; a column named like the output is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in the order of their listing. A case-insensitive flag of Java touches ASCII letters only.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
METHOD = ("entropy_hex", "entropy_alnum", "entropy_base64")
KINDS = (*BASE, *METHOD)

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabet of each class and the bits of entropy from which a window counts.
ALPHABET = {"entropy_hex": "0123456789abcdefABCDEF", "entropy_alnum": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "entropy_base64": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"}
THRESHOLD = {"entropy_hex": 3.0, "entropy_alnum": 3.8, "entropy_base64": 3.9}
#: A path of words and short numbers; identifiers, alphabets, placeholders and rules, which say nothing about what stands beside them.
WORD = r"^(?:[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*+[0-9]{0,12}|[A-Z]+[0-9]{0,12}|[0-9]{1,14})?$"
KNOWN = r"(?i)(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|0123456789|abcdefghij|qwertyuiop|example|placeholder|changeme|x{6,}|0{8,}|-{4,}|_{4,}|={4,})"
PIECES = rf"{KNOWN}|[/=]"
SEPARATORS = "[-_=+/]+"

#: Bits of a count, counts of a long, and matches of a chunk.
WIDE, EACH = 5, 12
CHUNK = 128
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _span(kind: int | Column, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), (F.lit(kind) if isinstance(kind, int) else kind).cast("int").alias("kind"), end.cast("int").alias("end"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value taken once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _chunks(items: Column) -> Column:
    """An array (a variable, taken many times) in chunks of CHUNK; an empty one has none."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, F.lit(CHUNK)))


def _matches(text: Column, pattern: str, keep: Callable[[Column], Column], kind: Callable[[Column], Column]) -> Column:
    """Spans of the non-overlapping matches from the left that keep() passes; what lies between matches gives their places."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    length = lambda x: F.coalesce(F.length(x), F.lit(0))
    sizes = F.transform(pairs, lambda x: F.struct(length(x["gap"]).alias("gap"), length(x["match"]).alias("n"), F.coalesce(keep(x["match"]), F.lit(False)).alias("hit"), kind(x["match"]).alias("kind")))

    def inside(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        return F.struct((begin + x["n"]).alias("at"), F.when(x["hit"], F.array_append(acc["found"], _span(x["kind"], begin, begin + x["n"]))).otherwise(acc["found"]).alias("found"))

    def across(acc: Column, chunk: Column) -> Column:
        own = F.aggregate(chunk, F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("found")), inside, lambda x: x["found"])
        return F.struct(F.aggregate(chunk, acc["at"], lambda at, x: at + x["gap"] + x["n"]).alias("at"), F.array_append(acc["found"], own).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))
    found = _let(sizes, lambda z: F.aggregate(_chunks(z), start, across, lambda acc: F.flatten(acc["found"])))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def _apart(spans: Column, others: Column) -> Column:
    """The spans, sorted and disjoint, that meet none of the others."""
    meet = lambda x, y: (y["start"] < x["end"]) & (x["start"] < y["end"])

    def part(chunk: Column) -> Column:
        whole = F.struct(F.element_at(chunk, 1)["start"].alias("start"), F.element_at(chunk, -1)["end"].alias("end"))
        near = F.filter(others, lambda y: meet(whole, y))
        return _let(near, lambda z: F.filter(chunk, lambda x: ~F.exists(z, lambda y: meet(x, y))))

    return F.flatten(F.transform(_chunks(spans), part))


def _n_log_n(n: int) -> float:
    return n * math.log2(n) if n > 1 else 0.0


def best_entropy(string: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest Shannon entropy in bits of any window of the string (of the whole string, if shorter); all its characters are of the alphabet."""
    codes = F.transform(F.filter(F.split(string, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    late = F.slice(F.concat(F.array_repeat(F.lit(-1), window), codes), F.lit(1), F.size(codes))
    slides = F.transform(F.arrays_zip(codes.alias("enter"), late.alias("leave")), lambda x: F.struct(_place(x["enter"]).alias("enter"), _place(x["leave"]).alias("leave"), (x["leave"] >= 0).alias("full"), (x["enter"] == x["leave"]).alias("same")))
    gain = F.array(*(F.lit(_n_log_n(n + 1) - _n_log_n(n)) for n in range(window)))
    loss = F.array(*(F.lit(_n_log_n(n - 1) - _n_log_n(n)) for n in range(1, window + 1)))
    start = F.struct(F.array(*[F.lit(0).cast("long")] * -(-len(alphabet) // EACH)).alias("count"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def slide(acc: Column, x: Column) -> Column:
        """The window one place further; the entropy of the place before is looked at first."""
        enter, leave = x["enter"], x["leave"]
        held = lambda c: F.call_function("shiftright", F.get(acc["count"], c["word"]), c["shift"]).bitwiseAND(F.lit((1 << WIDE) - 1)).cast("int")
        count = F.transform(acc["count"], lambda v, k: v + F.when(k == enter["word"], enter["one"]).otherwise(0) - F.when(k == leave["word"], leave["one"]).otherwise(0))
        total = acc["sum"] + F.get(gain, held(enter)) + F.when(x["full"], F.get(loss, held(leave) - 1)).otherwise(0.0)
        best = F.when(acc["n"] >= window, F.greatest(acc["best"], _bits(acc))).otherwise(acc["best"])
        return F.struct(F.when(x["same"], acc["count"]).otherwise(count).alias("count"), F.least(acc["n"] + 1, F.lit(window)).alias("n"), F.when(x["same"], acc["sum"]).otherwise(total).alias("sum"), best.alias("best"))

    return F.when(F.length(string) > 0, F.aggregate(slides, start, slide, lambda acc: F.greatest(acc["best"], _bits(acc)))).otherwise(F.lit(0.0))


def _place(code: Column) -> Column:
    """Where the count of a character stands: long, shift, and a one at that place; no long for no character."""
    shift = F.when(code >= 0, WIDE * (code % EACH)).otherwise(0).cast("int")
    return F.struct(F.floor(code / EACH).cast("int").alias("word"), shift.alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("one"))


def _bits(acc: Column) -> Column:
    width = acc["n"].cast("double")
    return F.log2(width) - acc["sum"] / width


def _class(string: Column) -> Column:
    """Index in KINDS of the smallest class that holds the string."""
    return F.when(string.rlike(r"^[0-9a-fA-F]+$"), F.lit(3)).when(string.rlike(r"^[0-9A-Za-z]+$"), F.lit(4)).otherwise(F.lit(5))


def _dense(string: Column) -> Column:
    """Whether the string has a letter, a digit, and a window of enough entropy for its class."""
    name = _class(string)
    enough = F.when(name == 3, best_entropy(string, ALPHABET["entropy_hex"]) >= THRESHOLD["entropy_hex"])
    enough = enough.when(name == 4, best_entropy(string, ALPHABET["entropy_alnum"]) >= THRESHOLD["entropy_alnum"])
    enough = enough.otherwise(best_entropy(string, ALPHABET["entropy_base64"]) >= THRESHOLD["entropy_base64"])
    return F.when(string.rlike("[0-9]") & string.rlike("[A-Za-z]"), enough).otherwise(F.lit(False))


def _secret(string: Column) -> Column:
    """Whether a candidate is a secret: dense and no path, and with something known in it, so is one of its other pieces."""
    path = string.contains("/") & F.forall(F.split(string, SEPARATORS), lambda x: x.rlike(WORD))
    pieces = F.filter(F.split(string, PIECES, -1), lambda x: (F.length(x) >= WINDOW))
    other = F.when(string.rlike(KNOWN), F.exists(pieces, _dense)).otherwise(F.lit(True))
    return F.when(path, F.lit(False)).when(_dense(string), other).otherwise(F.lit(False))


def scan(df: DataFrame, text: str = "text", into: str = "secret_spans") -> DataFrame:
    """df with its spans, array<struct<start, kind, end>> by start and then kind; kind is an index of KINDS."""
    t = F.coalesce(F.col(text), F.lit(""))
    fixed = lambda k: lambda m: F.lit(k)
    base = F.concat(
        _matches(t, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, fixed(0)),
        _matches(t, ACCESS, lambda m: m.isNotNull(), fixed(1)),
        _matches(t, HEX, lambda m: m.isNotNull(), fixed(2)),
    )
    staged = df.withColumn("_base_spans", base).withColumn("_more_spans", _matches(t, CANDIDATE, _secret, _class))
    fresh = F.when(F.size("_base_spans") > 0, _apart(F.col("_more_spans"), F.col("_base_spans"))).otherwise(F.col("_more_spans"))
    return staged.withColumn(into, F.array_sort(F.concat(F.col("_base_spans"), fresh))).drop("_base_spans", "_more_spans")


def described(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", spans: str = "secret_spans", mask: str = "[secret]") -> DataFrame:
    """df with each span of its text, or run of overlapping spans, replaced by the mask; texts without spans stay as they are."""
    t = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def part(acc: Column, chunk: Column) -> Column:
        end = F.greatest(acc["at"], F.array_max(F.transform(chunk, lambda x: x["end"])))

        def inside(own: Column, x: Column, here: Column) -> Column:
            apart = x["start"] >= own["at"]
            out = F.when(apart, F.concat(own["out"], F.substring(here, own["at"] - acc["at"] + 1, x["start"] - own["at"]), F.lit(mask))).otherwise(own["out"])
            return F.struct(F.greatest(own["at"], x["end"]).alias("at"), out.alias("out"))

        piece = _let(F.substring(t, acc["at"] + 1, end - acc["at"]), lambda here: F.aggregate(chunk, F.struct(acc["at"].alias("at"), F.lit("").alias("out")), lambda own, x: inside(own, x, here), lambda own: own["out"]))
        return F.struct(end.alias("at"), F.array_append(acc["out"], piece).alias("out"))

    done = F.aggregate(_chunks(F.col(spans)), start, part, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    return df.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(t))
