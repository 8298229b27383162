"""The corpus pipeline: language, near-duplicates, secrets, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result and reads it
again for the next stage. All but the last return the columns of documents, extra ones included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import byte_bpe, language_id, near_dedup, secret_scan, source_mix
from lumenfold.llm.queries import PATTERN, VOCABULARY
from lumenfold.llm.shared import table, word_count, written

#: Bits a character above which a text resembles no language. On the labelled documents of sf0.1 the median is 2.5, the 99.9th
#: percentile 4.4 and the most 6.0 (23 characters); words of random letters have 7.5 to 9.4.
STRANGE = 7.0
#: Letters below which bits a character say nothing: the first phrase alone costs 15.
LEAST = 60
#: Of 100 letters, so many at most may be letters that no training text shows; beyond that, nothing is known of the text's language.
FOREIGN = 10


def _rest(names: list[str]) -> Column:
    """All columns but the text, which then goes beside them once."""
    return F.struct(*(n for n in names if n != "text")).alias("row")


def _unused(names: list[str], start: str) -> str:
    """A name that begins so and is in no list of column names."""
    while start.lower() in {n.lower() for n in names}:
        start += "_"
    return start


def _babble(model: tuple[tuple[str, str], ...]) -> Column:
    """Whether a text of known letters, long enough to tell, resembles no language. Short texts and those in other scripts do not count."""
    text = F.lower(F.col("text"))
    known = "".join(sorted({c for _, sample in model for c in sample.lower() if c.isalpha()}))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    own = F.regexp_count(text, F.lit(f"[{known}]")) if known else F.lit(0)
    return (own >= LEAST) & (100 * (letters - own) <= FOREIGN * letters) & (F.col("lang_bits") > STRANGE)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without a letter, or of random letters, go. A missing label is filled in.

    Without any labelled text there is no language to find, and documents with a letter stay unlabelled.
    """
    model = language_id.fit(docs, F.lit(True))
    names = docs.columns
    rows = docs.select(_rest(names), F.col("text").alias("text"))
    if not model:
        return docs.where(F.regexp_count("text", F.lit(r"\p{L}")) > 0)
    found = language_id.predict(rows, model)
    kept = found.where((F.col("lang_pred") != "und") & ~F.coalesce(_babble(model), F.lit(False)))
    new = {"lang": F.coalesce(F.col("row.lang"), F.col("lang_pred")), "text": F.col("text")}
    return kept.select(*(new[n].alias(n) if n in new else F.col(f"row.`{n}`").alias(n) for n in names))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; rows without an id stay.

    Rows of one id with different texts are documents of their own. Of rows with the same id, the one
    with the smallest hash over all columns stays, so that reruns agree; rows that are equal throughout are one.
    """
    names = docs.columns
    key = _unused(names, "_key")
    whole = F.struct(*names)
    place = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")  # in order of the ids
    keyed = docs.where("doc_id is not null").withColumn(key, F.concat(place, F.hex(F.xxhash64(whole)), F.hex(F.xxhash64(F.lit(1), whole))))
    marks = near_dedup.near_duplicates(keyed, key)
    kept = keyed.join(marks.where("kept").select(F.col("doc_id").alias(key)).distinct(), key, "left_semi")
    return kept.dropDuplicates([key]).select(*(F.col(f"`{n}`") for n in names)).unionByName(docs.where("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    names = docs.columns
    rows = docs.select(_rest(names), F.col("text").alias("text"))
    clean = secret_scan.redact(secret_scan.scan(rows))
    new = {"text": F.col("text"), "n_chars": F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return clean.select(*(new[n].alias(n) if n in new else F.col(f"row.`{n}`").alias(n) for n in names))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes."""
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), "doc_id", "source", word_count("text").alias("size"))
    sizes = written(rows.select("doc_id", "source", "size"), "sizes")
    goal = written(source_mix.targets(sizes), "targets")
    counted = source_mix.copies(source_mix.aimed(rows, goal), source_mix.expected_copies(), tie=F.xxhash64("row.text"), slim=source_mix.aimed(sizes, goal))
    drawn = counted.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return drawn.select(*(F.col(f"row.`{n}`").alias(n) for n in names))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids of each document, and whether they decode to its text.

    Ids are written before they are decoded, with a digest in the text's place: so no task holds an encoder and a decoder.
    """
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("digest")
    rows = written(byte_bpe.encode(docs.select("doc_id", "lang", "source", "text", digest), VOCABULARY, PATTERN, drop_text=True), "token_ids")
    back = byte_bpe.decode(rows, VOCABULARY)
    same = F.sha2("decoded", 256) == F.col("digest")
    return back.select("doc_id", "lang", "source", F.floor(F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("secret_scan", redact),
    ("source_mix", mix),
    ("byte_bpe", tokenize),
]

#: Language ID, near-duplicates and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
