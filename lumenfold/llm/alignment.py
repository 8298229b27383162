"""Alignment of two tokenizers over the same bytes.

Tokenising gives for each text, of either side, the byte offset after each token, and for each byte offset the
token that ends there. All after that is SQL functions: array_intersect of the two arrays of ends finds where both
tokenizers cut; there, transform looks up the two tokens that end together, the links, and sequence runs over the offsets since the link
before, whose tokens are the group. Nearly all groups are two tokens of one length, which need no such run. Pairs of linked ids are counted over the corpus with sums on the map side.

Counts go back to the documents by a broadcast where there are at most BROADCAST pairs. Beyond that, only pairs that
hold a share of 1 / HOT of all links are broadcast, at most HOT of them, and the others are joined by a shuffle in which no key is hot.

Defined cases: a text that is null, empty, or that either tokenizer does not give back byte by byte has no tokens, so zero counts, an
empty digest and no links; tokens have up to 2^11 bytes and ids up to 2^20; rows repeat as they come, each counts, ids may be null; an empty table gives an empty table;
columns of the given table pass through align() unless they have a name that it makes.
"""

from __future__ import annotations

import itertools
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from .shared import rows_of, small_batches, written
from .word_tokens import LETTER

#: Finished parts of texts that a worker keeps, of some 300 bytes each.
KEEP = 300_000
#: Pairs that may be broadcast, of some 70 bytes each.
BROADCAST = 1_000_000
#: A pair with a share of one in so many links is hot.
HOT = 10_000
#: Fixed value: how byte-level tokenizers of the library cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A single blank before a byte that begins no white space, and not after U+2581, which the piece tokenizer takes for a blank:
#: neither tokenizer has a token across the place before it.
CUT = re.compile(rb"(?<=[^\x20\x81]) (?=[!-~\xc3-\xdf\xe4-\xf4])")
ARRAYS = ("a_ends", "b_ends", "a_at", "b_at")
#: A token within a_at and b_at: its length in bytes above these bits, its id in them.
ID_BITS = 20


class ByteSide:
    """A byte-level file of the tokenizers library; special tokens' strings are plain text."""

    def __init__(self, raw: bytes) -> None:
        config = json.loads(raw)
        vocab, byte_of = config["model"]["vocab"], {letter: b for b, letter in LETTER.items()}
        special = {t["content"] for t in config["added_tokens"]}
        self.token = [b""] * (max([*vocab.values(), *(t["id"] for t in config["added_tokens"])]) + 1)
        for entry, i in vocab.items():
            self.token[i] = entry.encode() if entry in special else bytes(byte_of[c] for c in entry)
        merges = [m if isinstance(m, str) else " ".join(m) for m in config["model"]["merges"]]
        made = [vocab[m.replace(" ", "")] for m in merges]
        pre = config.get("pre_tokenizer") or {}
        plain = config.get("normalizer") is None and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True)
        rest = {vocab[e] for e in vocab if len(e) > 1 and e not in special}
        self.cuts = bool(plain and made == sorted(set(made)) and rest == set(made) and not any(config["model"].get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "dropout")))
        ranks = {self.token[i]: i for e, i in vocab.items() if e not in special}
        self.lossless = self.cuts
        self.library = None if self.cuts else Tokenizer.from_str(raw.decode())
        if self.library:
            self.library.encode_special_tokens = True
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if self.cuts else None  # ids in order of merges are ranks

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a blank and each text."""
        if self.fast:
            return [self.fast.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceSide:
    """A model file of the sentencepiece library."""

    def __init__(self, raw: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(raw)
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        byte = {f"<0x{b:02X}>": bytes([b]) for b in range(256)}
        self.token = [byte[p.piece] if p.type == kind.BYTE else p.piece.replace("▁", " ").encode() for p in model.pieces]
        how = model.normalizer_spec
        self.lossless = False
        self.cuts = (
            how.name == "identity" and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
            and all(p.type in (kind.NORMAL, kind.BYTE, kind.CONTROL, kind.UNKNOWN) for p in model.pieces) and not any(re.search("[^▁]▁", p.piece) for p in model.pieces if p.type == kind.NORMAL)
            and model.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        )

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, before which the model puts a blank."""
        return self.library.encode(texts, num_threads=1)


class Sides:
    """Both tokenizers, and what they made of parts that recur."""

    def __init__(self, raw_a: bytes, raw_b: bytes) -> None:
        self.sides = ByteSide(raw_a), PieceSide(raw_b)
        self.cuts = all(s.cuts for s in self.sides)
        self.size = [np.array([len(t) for t in s.token], np.int32) for s in self.sides]
        self.done: tuple[dict[bytes, bytes], dict[bytes, bytes]] = ({}, {})
        self.odd: set[bytes] = set()

    def _learn(self, parts: list[bytes]) -> None:
        texts = [p.decode() for p in parts]
        for side, done in zip(self.sides, self.done, strict=True):
            made, token = side.encode(texts), side.token.__getitem__
            done.update(zip(parts, [array("i", ids).tobytes() for ids in made], strict=True))
            if not side.lossless:
                self.odd.update(raw for raw, ids in zip(parts, made, strict=True) if b"".join(map(token, ids)) != b" " + raw)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text; none where a side's bytes are not those of the text."""
        if len(self.done[0]) > KEEP:  # what came early is what comes often
            self.done = tuple(dict(itertools.islice(d.items(), KEEP // 2)) for d in self.done)
            self.odd &= self.done[0].keys()
        cut = [CUT.split(t.encode()) if self.cuts else [t.encode()] for t in texts]
        fresh = list(set().union(*cut).difference(self.done[0]))
        for i in range(0, len(fresh), 8192):
            self._learn(fresh[i : i + 8192])
        get_a, get_b = (d.__getitem__ for d in self.done)
        out: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for text, parts in zip(texts, cut, strict=True):
            if not text or self.odd and not self.odd.isdisjoint(parts) and not self._same(text.encode(), parts):
                parts = []
            out[0].append(np.frombuffer(b"".join(map(get_a, parts)), np.int32))
            out[1].append(np.frombuffer(b"".join(map(get_b, parts)), np.int32))
        return out

    def _same(self, raw: bytes, parts: list[bytes]) -> bool:
        """Whether both sides give back a blank and the text."""
        ids = (np.frombuffer(b"".join(map(d.__getitem__, parts)), np.int32).tolist() for d in self.done)
        return all(b"".join(map(s.token.__getitem__, x)) == b" " + raw for s, x in zip(self.sides, ids, strict=True))


@lru_cache(1)
def sides(raw_a: bytes, raw_b: bytes) -> Sides:
    """The worker's pair of tokenizers."""
    return Sides(raw_a, raw_b)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32, copy=False)))


def tokenised(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """df without its text, with a_ends and b_ends, the byte offset after each token of blank and text, and a_at and b_at: for each offset the token
    that ends there, as its length << ID_BITS | its id, or -1.

    a_path: a byte-level file of the tokenizers library; b_path: a model of the sentencepiece library; both on the driver.
    """
    raw = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            raw.append(f.read())
    held = df.sparkSession.sparkContext.broadcast(tuple(raw))  # vocabularies, a few MB
    taken = {x.lower() for x in (text, *ARRAYS)}
    keep = [f for f in df.schema.fields if f.name.lower() not in taken]
    names = [f.name for f in keep]
    ints = T.ArrayType(T.IntegerType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = sides(*held.value)
        for part, texts in rows_of(batches, "_text"):
            ends, at = ([], []), ([], [])
            for k, found in enumerate(pair.encode(texts)):
                for ids in found:
                    size = pair.size[k][ids]
                    end = np.cumsum(size, dtype=np.int32)
                    mark = np.full(int(end[-1]) + 1 if len(end) else 0, -1, np.int32)
                    mark[end] = size << ID_BITS | ids
                    ends[k].append(end)
                    at[k].append(mark)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *map(_lists, (*ends, *at))], [*names, *ARRAYS])

    rows = df.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text}`").alias("_text"))
    return rows.transform(small_batches).mapInArrow(run, T.StructType([*keep, *(T.StructField(n, ints, False) for n in ARRAYS)]))


def _id(token: Column) -> Column:
    return token.bitwiseAND((1 << ID_BITS) - 1)


def _within(k: Column, at: str, one: Callable[[Column], Column]) -> Column:
    """one(id) of each of a side's tokens in group k: those that end after the cut before it, up to its own. No slice(): within a lambda it copies the whole array."""
    places = F.sequence(F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("_cuts"), k - 1)) + 1, F.get(F.col("_cuts"), k))
    return F.transform(F.filter(F.transform(places, lambda e: F.get(F.col(at), e)), lambda t: t >= 0), lambda t: one(_id(t)))


def linked(df: DataFrame) -> DataFrame:
    """tokenised() with n_a and n_b, and links: for each place where both sides cut the ids a and b that end there, and its group as text, `a1,a2|b1,b2`, if it is no more than these."""
    cuts = df.select("*", F.array_intersect("a_ends", "b_ends").alias("_cuts"), F.size("a_ends").cast("long").alias("n_a"), F.size("b_ends").cast("long").alias("n_b")).drop("a_ends", "b_ends")
    token = lambda at: F.transform("_cuts", lambda e: F.get(F.col(at), e))

    def link(a: Column, b: Column) -> Column:
        alone = F.shiftright(a, ID_BITS) == F.shiftright(b, ID_BITS)
        return F.struct(_id(a).alias("a"), _id(b).alias("b"), F.when(alone, F.concat(_id(a).cast("string"), F.lit("|"), _id(b).cast("string"))).alias("text"))

    return cuts.select("*", F.zip_with(token("a_at"), token("b_at"), link).alias("links"))


def groups() -> Column:
    """Of linked(): the ids (a, b) of each stretch between places where both tokenizers cut."""
    return F.transform("_cuts", lambda _, k: F.struct(_within(k, "a_at", lambda x: x).alias("a"), _within(k, "b_at", lambda x: x).alias("b")))


def described() -> Column:
    """Of linked(): the groups as text, `a1,a2|b1;a3|b2,b3`."""
    line = lambda k, at: F.array_join(_within(k, at, lambda x: x.cast("string")), ",")
    return F.array_join(F.transform("links", lambda x, k: F.coalesce(x["text"], F.concat(line(k, "a_at"), F.lit("|"), line(k, "b_at")))), ";")


def _exploded(links: DataFrame, *others: str) -> DataFrame:
    """others, a and b of each link."""
    return links.select(*others, F.explode(F.arrays_zip("a", "b")).alias("x")).select(*others, "x.a", "x.b")


def counted(links: DataFrame) -> DataFrame:
    """(a, b, n, best): how often each pair of ids is linked over all rows (a, b: arrays), and whether no other pair of b is more often."""
    n = written(_exploded(links).groupBy("a", "b").agg(F.count("*").alias("n")), "pair_counts")
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return written(n.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def scored(links: DataFrame, counts: DataFrame, key: str, broadcast: int = BROADCAST, hot: int = HOT) -> DataFrame:
    """(key, n_best, count_sum) of each row of links (key, a, b) that has a link: links whose pair is its b's best, and the sum of the pairs' counts."""
    flat, one = _exploded(links, key), F.lit(1).cast("long").alias("times")
    size, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size <= broadcast:
        met = flat.join(F.broadcast(counts), ["a", "b"]).select(key, "n", "best", one)
    else:
        often = counts.where(F.col("n") * hot >= total)  # at most `hot` rows
        many = flat.join(F.broadcast(often), ["a", "b"]).select(key, "n", "best", one)
        few = flat.join(F.broadcast(often.select("a", "b")), ["a", "b"], "left_anti").groupBy(key, "a", "b").agg(F.count("*").alias("times"))
        met = many.unionByName(few.join(counts.where(F.col("n") * hot < total), ["a", "b"]).select(key, "n", "best", "times"))
    return met.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """df without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    own = {"n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "_row", "a", "b", "links", "_cuts"}
    others = [c for c in df.columns if c.lower() not in {*own, *ARRAYS} and c != text]
    found = linked(tokenised(df.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text}`")), a_path, b_path, text))
    names, count = [F.col(f"`{c}`") for c in others], F.size("links").cast("long")
    digest = F.when(F.size("links") > 0, F.sha2(described().cast("binary"), 256)).otherwise(F.lit(""))
    flat = found.select(*names, "n_a", "n_b", count.alias("n_groups"), count.alias("n_links"), digest.alias("groups_sha256"), F.col("links.a").alias("a"), F.col("links.b").alias("b"))
    held = written(flat.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    marks = scored(held.select("_row", "a", "b"), counted(held.select("a", "b")), "_row")
    whole = held.drop("a", "b").join(marks, "_row", "left").drop("_row")
    return whole.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
