"""Ids of the tokenizers library for many texts, by way of the chunks between blanks.

Where a tokenizer is of the kind checked by `cuts_at_blanks` (composed, lower-cased, pieces that never hold
white space), the ids of a text are those of its chunks one after the other, for white space is what its
pattern drops, and composition does not cross it. Chunks recur, so each task keeps a bounded table of finished ones. A
chunk of plain letters, digits and signs is cut to pieces here and each piece goes to the library's model;
any other chunk, those with a special token's string included, goes to the library whole, as whole texts do for tokenizers of any other kind.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: Finished chunks, and pieces, that a worker keeps, of some 200 bytes each.
KEEP = 500_000
#: Chunks of one text that are in memory at once.
BLOCK = 200_000
#: Letters of one case pair each, whose lower case is one composed letter: printable ASCII, Latin-1 and Latin Extended-A but for U+0130.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿā-įı-ſ]+|[0-9]|[^a-z0-9ß-öø-ÿā-įı-ſ]+")
#: What such a tokenizer's file says.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTER = byte_letters()


def cuts_at_blanks(config: dict) -> bool:
    """Whether a tokenizer's ids are those of the chunks between ASCII blanks."""
    pre = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = pre[0].get("type") == "Split" and pre[0].get("pattern") == {"Regex": PATTERN} and pre[0].get("behavior") == "Removed" and pre[0].get("invert")
    level = [(p.get("type"), p.get("add_prefix_space"), p.get("use_regex")) for p in pre[1:]] == [("ByteLevel", False, False)]
    special = all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in config["added_tokens"])
    return bool(split and level and special and config.get("normalizer") == NORMALIZER and config.get("post_processor") is None and config.get("truncation") is None and config.get("padding") is None)


class Words:
    """Encodes texts by a tokenizer's file."""

    def __init__(self, raw: bytes) -> None:
        config = json.loads(raw)
        self.library = Tokenizer.from_str(raw.decode())
        self.model = self.library.model
        self.chunked = cuts_at_blanks(config)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in config["added_tokens"]) or r"(?!)")
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Packed ids of a piece that is not kept yet."""
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(LETTER)
        found = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found

    def _learn(self, chunks: set[bytes]) -> None:
        """Encode chunks that are not kept yet."""
        whole, get, own = [], self.pieces.get, self._piece
        plain, special, cut = PLAIN.fullmatch, self.special.search, PIECE.findall
        for raw in chunks:
            chunk = raw.decode()
            if plain(chunk) and not special(chunk):
                self.chunks[raw] = b"".join([get(p) or own(p) for p in cut(chunk.lower())])
            else:
                whole.append(raw)
        for i in range(0, len(whole), 1024):
            part = whole[i : i + 1024]
            made = self.library.encode_batch_fast([raw.decode() for raw in part], add_special_tokens=False)
            self.chunks.update((raw, array("I", e.ids).tobytes()) for raw, e in zip(part, made, strict=True))

    def _of(self, chunks: list[bytes]) -> bytes:
        for name in ("chunks", "pieces"):  # what came early is what comes often
            kept = getattr(self, name)
            if len(kept) > KEEP:
                setattr(self, name, dict(itertools.islice(kept.items(), KEEP // 2)))
        fresh = set(chunks).difference(self.chunks)
        if fresh:
            self._learn(fresh)
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (unsigned 32-bit of the machine's order) of each text, without special tokens of the library's own."""
        if not self.chunked:
            return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for text in texts:
            chunks = text.encode().split()
            out.append(b"".join(self._of(chunks[i : i + BLOCK]) for i in range(0, len(chunks), BLOCK)))
        return out


@lru_cache(1)
def words(raw: bytes) -> Words:
    """The worker's encoder for this file."""
    return Words(raw)
