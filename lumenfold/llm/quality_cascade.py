"""Quality rules as a short-circuit cascade.

Every document gets base measures of its whole text; a document that they fail is out. The rest goes
through rules, each a cheap or dear look at the text that says reject or pass. The order is chosen on
a sample: the rules run on it one by one, timed, and then stand by the rejections that a nanosecond
buys. A document stops at its first rejection, so the order changes the time, never the verdict.

The sample is a bounded number of rows picked by a hash of the id; it only orders the rules. Its
texts stay on the executors; a row for each rule comes back.

Defined cases: null or empty text has no words, fails the base rule and is not kept; very long texts
take time in proportion to their length; repeated rows get equal results; an empty table gives an
empty table and rules in the order listed; columns named like the outputs are replaced.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import rows_of, small_batches

#: The symbols that n_symbols counts, and the white space between words.
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\v\f\r"
SAMPLE = 400


def repeated_words(words: list[str]) -> int:
    """Words inside windows of five words that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))  # noqa: B905
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + 5 - max(i, upto)
            upto = i + 5
    return covered


def measures(text: str) -> tuple[list[str], tuple[int, int, int, int, int]]:
    """Words, and (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]  # bytes split at exactly these blanks
    chars = len(text) - sum(map(text.count, BLANK))
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    return words, (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


#: A rule looks at text, words and measures and says whether to reject.
Rule = Callable[[str, list[str], tuple[int, int, int, int, int]], bool]


def _odd_word_length(text: str, words: list[str], m: tuple[int, ...]) -> bool:
    return not 2 * m[0] <= m[1] <= 16 * m[0]


def _symbol_heavy(text: str, words: list[str], m: tuple[int, ...]) -> bool:
    return m[2] > m[0]


def _same_lines(text: str, words: list[str], m: tuple[int, ...]) -> bool:
    return 2 * m[3] > text.count("\n") + 1


def _few_letters(text: str, words: list[str], m: tuple[int, ...]) -> bool:
    return 2 * sum(any(map(str.isalpha, w)) for w in words) < m[0]


def _one_word(text: str, words: list[str], m: tuple[int, ...]) -> bool:
    return m[0] >= 50 and 3 * max(Counter(words).values()) > m[0]


def _bullets(text: str, words: list[str], m: tuple[int, ...]) -> bool:
    lines = text.split("\n")
    return len(lines) >= 5 and 10 * sum(line.lstrip(BLANK)[:1] in ("-", "*", "•") and bool(line.strip(BLANK)) for line in lines) > 9 * len(lines)


def _cut_lines(text: str, words: list[str], m: tuple[int, ...]) -> bool:
    lines = text.split("\n")
    return len(lines) >= 5 and 10 * sum(line.rstrip(BLANK).endswith(("...", "…")) for line in lines) > 3 * len(lines)


RULES: dict[str, Rule] = {"odd_word_length": _odd_word_length, "symbol_heavy": _symbol_heavy, "same_lines": _same_lines, "few_letters": _few_letters, "one_word": _one_word, "bullets": _bullets, "cut_lines": _cut_lines}


def base_failed(m: tuple[int, ...]) -> bool:
    """Too short, or mostly repetition."""
    return m[0] < 10 or 100 * m[4] > 20 * m[0]


def plan(df: DataFrame, key: str = "doc_id", text: str = "text", rules: dict[str, Rule] = RULES, sample: int = SAMPLE) -> list[str]:
    """Names of the rules by rejections a nanosecond on the sample, most first; ties as listed."""
    total = df.count()
    if not total:
        return list(rules)
    share = min(1.0, sample / total)
    picked = df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("cascade")), F.lit(1 << 40)) < int(share * (1 << 40))).select(text)

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in rows_of(batches, text):
            spent, out = Counter(), Counter()
            for t in texts:
                words, m = measures(t)
                if base_failed(m):
                    continue
                for name, rule in rules.items():
                    began = time.perf_counter_ns()
                    out[name] += rule(t, words, m)
                    spent[name] += time.perf_counter_ns() - began
            yield pa.RecordBatch.from_arrays([pa.array(list(rules)), pa.array([spent[n] for n in rules], pa.int64()), pa.array([out[n] for n in rules], pa.int64())], ["rule", "ns", "rejected"])

    seen = {r[0]: r[2] / max(1, r[1]) for r in picked.transform(small_batches).mapInArrow(timed, "rule string, ns long, rejected long").groupBy("rule").agg(F.sum("ns"), F.sum("rejected")).collect()}
    return sorted(rules, key=lambda name: -seen.get(name, 0.0))


def run(df: DataFrame, order: list[str], text: str = "text", rules: dict[str, Rule] = RULES, drop_text: bool = False) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept."""
    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
    gone = {f.name for f in fields} | ({text.lower()} if drop_text else set())
    keep = [f for f in df.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in keep]
    cascade = [rules[n] for n in order]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in rows_of(batches, text):
            rows = []
            for t in texts:
                words, m = measures(t)
                failed = base_failed(m)
                rows.append((*m, failed, not failed and not any(rule(t, words, m) for rule in cascade)))
            made = [pa.array(list(c), pa.int64() if i < 5 else pa.bool_()) for i, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], [*names, *(f.name for f in fields)])

    return df.transform(small_batches).mapInArrow(judge, T.StructType([*keep, *fields]))
