"""Language identification by cross-parsing entropy.

Each language keeps a suffix automaton of labelled text. A text is parsed, from left to right, into
the longest phrases that the language's text contains; few phrases mean that the text looks like it.
The phrases, times the bits that one phrase's address costs, over the text's length, estimate the
cross entropy in bits a character, and the language with the smallest wins.

The alphabet holds every letter of the training texts; all that is no letter is one symbol. The transitions
of all automata stand in one sparse table, so a step of the parse is one lookup, taken at once
for many blocks of many texts and for all languages. Blocks have 1,024 characters; phrases end with
their block. Whole texts are parsed.

fit() takes a bounded sample: of the labelled rows, by a hash of id and text, so many documents of each
language that TRAIN_CHARS characters are there, PER_DOC of each document at most. The sample is all
that is collected, about languages x 3 x TRAIN_CHARS characters; everything else stays distributed.

Defined cases: null text, or text without a letter, gives `und` with score 0; without any labelled
row every text does; equal entropies go to the language that sorts first; repeated rows get equal
results; an empty table gives an empty table; columns named like the outputs are replaced; null
labels teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import give_back, rows_of, small_batches

TRAIN_CHARS = 40_000
PER_DOC = 1_000
BLOCK = 1024


def automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence: for each state, the state that a symbol leads to."""
    rows: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols.tolist():
        new = len(rows)
        rows.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in rows[p]:
            rows[p][s] = new
            p = link[p]
        if p >= 0:
            q = rows[p][s]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(rows)
                rows.append(dict(rows[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and rows[p].get(s) == q:
                    rows[p][s] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return rows


class Steps:
    """Transitions of many states over any alphabet in one sparse table.

    A state is named by a place of its own, and its transition by a symbol stands at that place plus the symbol, where
    `owner` names the state. Places are drawn, states with many transitions first, until no two transitions meet.
    """

    def __init__(self, state: np.ndarray, symbol: np.ndarray, to: np.ndarray, states: int, width: int) -> None:
        size = 5 * max(len(state), states) // 2 + width
        draw = np.random.default_rng(7)
        many = np.bincount(state, minlength=states)
        self.name = np.full(states, -1, np.int64)
        self.owner = np.full(size + width, -1, np.int32)
        claim, taken = np.full(size + width, -1, np.int32), np.zeros(size, bool)
        for least in (64, 32, 16, 8, 4, 2, 1, 0):
            open_ = np.flatnonzero((many >= least) & (self.name < 0))
            mine = np.isin(state, open_)
            own, of = state[mine], symbol[mine]
            while len(open_):
                self.name[open_] = draw.integers(0, size, len(open_))
                at, slot, bad = self.name[open_], self.name[own] + of, np.zeros(states, bool)
                claim[slot] = own
                bad[own[(self.owner[slot] >= 0) | (claim[slot] != own)]] = True
                claim[at] = open_
                bad[open_[taken[at] | (claim[at] != open_)]] = True
                fine = ~bad[own]
                self.owner[slot[fine]] = self.name[own[fine]]
                taken[at[~bad[open_]]] = True
                open_, own, of = open_[bad[open_]], own[~fine], of[~fine]
        self.to = np.zeros(size + width, np.int32)
        self.to[self.name[state] + symbol] = self.name[to]

    def take(self, names: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the states that the symbols lead to, and the places of those that lead nowhere, whose value is void."""
        slot = names + symbols
        return self.to.take(slot), np.flatnonzero(self.owner.take(slot) != names)


class Parser:
    """Parses texts against every language of a model: ((language, training text), ...)."""

    def __init__(self, model: tuple[tuple[str, str], ...]) -> None:
        self.languages = [name for name, _ in model]
        letters = sorted({c for _, text in model for c in text.lower() if c.isalpha()})
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.symbol = self.letter.astype(np.int32)  # 0: no letter, 1: a letter that no training text shows
        self.symbol[[ord(c) for c in letters]] = np.arange(len(letters)) + 2
        self.width = len(letters) + 2
        parts, root, states = [], [], 0
        for _, text in model:
            rows = automaton(self._symbols(text))
            size = [len(row) for row in rows]
            flat = np.array([x for row in rows for x in row.items()], np.int64).reshape(-1, 2)
            parts.append(np.column_stack([np.repeat(np.arange(len(rows)) + states, size), flat[:, 0], flat[:, 1] + states]))
            root.append(states)
            states += len(rows)
        self.step = Steps(*np.concatenate(parts).T, states, self.width) if parts else None
        self.root = self.step.name[root] if parts else np.zeros(0, np.int64)
        self.bits = np.array([np.log2(max(2, len(text))) for _, text in model])

    def _codes(self, text: str) -> np.ndarray:
        return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)

    def _symbols(self, text: str) -> np.ndarray:
        return self.symbol[self._codes(text)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Number of phrases, a row for each text and a column for each language."""
        coded = [self._symbols(t) for t in texts]
        sizes = np.array([len(c) for c in coded])
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK  # where in its text a block begins
        size = np.minimum(BLOCK, sizes[owner] - place)
        order = np.argsort(-size, kind="stable")
        size, begin, owner = size[order], ((np.cumsum(sizes) - sizes)[owner] + place)[order], owner[order]
        flat = np.concatenate(coded)
        active = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # blocks longer than t
        many = len(self.languages)
        root = self.root[:, None]
        state = np.tile(root, (1, len(owner)))
        count = np.zeros((many, len(owner)), np.int32)
        for t in range(BLOCK):
            k = active[t]
            if not k:
                break
            symbol = flat[begin[:k] + t]
            to, stuck = self.step.take(state[:, :k].ravel(), np.tile(symbol, many))
            if len(stuck):
                language, column = np.divmod(stuck, k)
                count[language, column] += 1  # the phrase before this symbol ends
                again, alone = self.step.take(self.root[language], symbol[column])
                again[alone] = self.root[language[alone]]  # a symbol that the language never shows is a phrase of its own
                to[stuck] = again
            state[:, :k] = to.reshape(many, k)
        count += state != root  # the last phrase of the block
        total = np.zeros((len(texts), many), np.int64)
        np.add.at(total, owner, count.T)
        return total

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float | None]]:
        """Language, score and bits a character of each text; score: how far the second language is behind, as a share of its entropy."""
        found, score, bits = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        use = [i for i, t in enumerate(texts) if self.languages and self.letter[self._codes(t)].any()] if self.languages else []
        if use:
            cost = self.phrases([texts[i] for i in use]) * self.bits
            best = cost.argmin(1)
            low = cost[np.arange(len(use)), best]
            cost[np.arange(len(use)), best] = np.inf
            second = cost.min(1) if len(self.languages) > 1 else np.full(len(use), np.inf)
            for i, b, x, y in zip(use, best.tolist(), low.tolist(), second.tolist(), strict=True):
                found[i] = self.languages[b]
                bits[i] = x / len(texts[i])
                score[i] = 1.0 if y == np.inf else max(0.0, min(1.0, 1 - x / y)) if y else 0.0
        return found, score, bits


@lru_cache(1)
def parser(model: tuple[tuple[str, str], ...]) -> Parser:
    """The worker's parser of this model; what its making needed is given back."""
    made = Parser(model)
    give_back()
    return made


def fit(df: DataFrame, where: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", train_chars: int = TRAIN_CHARS) -> tuple[tuple[str, str], ...]:
    """Model from the rows of `where` that have a label and a text, sorted by language."""
    labelled = df.where(where & F.col(lang).isNotNull() & (F.length(text) > 0))
    there = {r[0]: r[1] for r in labelled.groupBy(lang).agg(F.sum(F.least(F.length(text), F.lit(PER_DOC)))).collect()}  # a row for each language
    if not there:
        return ()
    rank = F.pmod(F.xxhash64(F.col(key).cast("string"), text), F.lit(1 << 40))
    share = F.create_map(*(F.lit(x) for name, n in there.items() for x in (name, int(min(1.0, 3 * train_chars / n) * (1 << 40)))))
    rows = labelled.where(rank < share[F.col(lang)]).select(lang, rank.alias("_rank"), F.substring(text, 1, PER_DOC).alias("_text")).collect()
    taken: dict[str, str] = {}
    for name, _, sample in sorted(rows):
        if len(taken.get(name, "")) < train_chars:
            taken[name] = (taken.get(name, "") + "\n" + sample)[: train_chars]
    return tuple(sorted((name, sample) for name, sample in taken.items() if any(c.isalpha() for c in sample)))


def predict(df: DataFrame, model: tuple[tuple[str, str], ...], text: str = "text", into: str = "lang_pred", score: str = "score", bits: str = "lang_bits", drop_text: bool = False) -> DataFrame:
    """df with the predicted language, its score (0 to 1) and its cross entropy in bits a character (null for `und`)."""
    held = df.sparkSession.sparkContext.broadcast(model)
    gone = {into.lower(), score.lower(), bits.lower(), *([text.lower()] if drop_text else [])}
    keep = [f for f in df.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(into, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(bits, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = parser(held.value)
        for part, texts in rows_of(batches, text, 2 << 20):
            found, sure, cost = parse.predict(texts)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found, pa.string()), pa.array(sure, pa.float64()), pa.array(cost, pa.float64())], [*names, into, score, bits])

    return df.transform(small_batches).mapInArrow(run, schema)


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """True for the fifth of the rows that fit() must not see."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))
