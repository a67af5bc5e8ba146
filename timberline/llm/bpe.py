"""BPE encoding and decoding, with tree concatenation for long unsplit text.

White space ends every pre-token, so a text is encoded as the stretches between
its spaces and line breaks.  Stretches repeat, so each worker remembers those it
has seen, without their punctuation where all characters are below U+0250.  A stretch that is itself very long is encoded as a tree: its halves
in parallel, then windows around the join, growing until the window's tokens
agree with those of both halves.  A sequence is the BPE encoding of its text
exactly if each pair of neighbours is, so agreement on whole tokens at both
sides makes the joined sequence the encoding of the whole.

Contract (op5): ids and text as the tokenizers library gives for the whole text,
without added special tokens; decoding keeps special tokens.

Edge cases: null text is empty (no tokens, both digests of empty input); ties do
not arise; repeated rows are each encoded; other columns are ignored, whatever
their names; texts with the strings of special tokens encode to their ids.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

#: Characters of an unsplit stretch beyond which it is encoded as a tree, and of the first window on each side of a join.
LEAF_CHARS, FIRST_WINDOW = 4096, 64
#: Pre-tokens that a worker remembers.
REMEMBERED = 400_000

_SPACE = re.compile("[ \n\r\t]+")
#: The vocabulary's pre-token pattern, written out for the characters below U+0250, where NFC and lower case act on single characters.
_UNUSUAL = re.compile("[^\\x00-\u024f]|<\\|")
_PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-\u024f]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-\u024f0-9²³¹¼½¾]+")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

Token = tuple[int, int, int]


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TreeEncoder:
    """Encodes one unsplit stretch of any length."""

    def __init__(self, tokenizer, leaf: int = LEAF_CHARS, window: int = FIRST_WINDOW):
        self.tokenizer, self.leaf, self.window = tokenizer, leaf, window

    def ids(self, text: str) -> list[int]:
        return [t[0] for t in self.tokens(text)]

    def tokens(self, text: str) -> list[Token]:
        """(id, start, end) of each token, in characters of text."""
        leaves = max(1, -(-len(text) // self.leaf))
        cuts = [len(text) * i // leaves for i in range(leaves + 1)]
        with ThreadPoolExecutor(2) as pool:  # the library lets other threads run while it encodes
            parts = list(pool.map(lambda i: self._plain(text, cuts[i], cuts[i + 1]), range(leaves)))
        spans = [(cuts[i], cuts[i + 1]) for i in range(leaves)]
        while len(parts) > 1:
            joined, new = [], []
            for i in range(0, len(parts) - 1, 2):
                (lo, mid), (_, hi) = spans[i], spans[i + 1]
                joined.append(self._join(text, lo, mid, hi, parts[i], parts[i + 1]))
                new.append((lo, hi))
            if len(parts) % 2:
                joined.append(parts[-1])
                new.append(spans[-1])
            parts, spans = joined, new
        return parts[0]

    def _plain(self, text: str, lo: int, hi: int) -> list[Token]:
        e = self.tokenizer.encode(text[lo:hi], add_special_tokens=False)
        return [(i, a + lo, b + lo) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[Token], right: list[Token]) -> list[Token]:
        w = self.window
        while True:
            a, b = max(lo, mid - w), min(hi, mid + w)
            if a == lo and b == hi:
                return self._plain(text, lo, hi)
            seam = self._plain(text, a, b)
            at_left = (0, 0) if a == lo else self._agree(left, seam, a, mid)
            at_right = (len(right), len(seam)) if b == hi else self._agree_right(right, seam, mid, b)
            if at_left is not None and at_right is not None and at_left[1] <= at_right[1]:
                return left[: at_left[0]] + seam[at_left[1] : at_right[1]] + right[at_right[0] :]
            w *= 2

    @staticmethod
    def _agree(left: list[Token], seam: list[Token], a: int, mid: int) -> tuple[int, int] | None:
        """Where to go over from left to seam: after three alike tokens that are no longer at the window's edge."""
        where = {t[1:]: i for i, t in enumerate(left[-(4 * (mid - a) + 8) :], max(0, len(left) - (4 * (mid - a) + 8))) if t[1] >= a}
        edge = a + (mid - a) // 4
        for j in range(len(seam) - 2):
            if seam[j][1] >= edge and seam[j + 2][2] <= mid - (mid - a) // 4:
                i = where.get(seam[j][1:])
                if i is not None and left[i : i + 3] == seam[j : j + 3]:
                    return i + 2, j + 2
        return None

    @staticmethod
    def _agree_right(right: list[Token], seam: list[Token], mid: int, b: int) -> tuple[int, int] | None:
        where = {t[1:]: i for i, t in enumerate(right[: 4 * (b - mid) + 8]) if t[2] <= b}
        edge = b - (b - mid) // 4
        for j in range(len(seam) - 3, -1, -1):
            if seam[j + 2][2] <= edge and seam[j][1] >= mid + (b - mid) // 4:
                i = where.get(seam[j][1:])
                if i is not None and right[i : i + 3] == seam[j : j + 3]:
                    return i + 1, j + 1
        return None


class Codec:
    """Encodes and decodes whole texts; one for each worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tree = TreeEncoder(self.tokenizer)
        if self.tokenizer.decoder is not None:
            raise ValueError("only vocabularies whose decoder joins tokens by spaces can be decoded stretch by stretch")
        self.token = [(" " + (self.tokenizer.id_to_token(i) or "")).encode("utf-8") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))].__getitem__
        tokens = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True)))
        self.ends_word = np.array([x.endswith("</w>") for x in tokens])
        self.seen: dict[str, tuple[bytes, bytes]] = {}

    def _coded(self, stretches: list[str]) -> list[tuple[bytes, bytes]]:
        """For each stretch: its ids as little-endian unsigned 32-bit integers, and their decoded text with a leading space."""
        ids = [e.ids if len(s) <= LEAF_CHARS else self.tree.ids(s) for s, e in zip(stretches, self.tokenizer.encode_batch_fast([s if len(s) <= LEAF_CHARS else "" for s in stretches], add_special_tokens=False), strict=True)]
        return [(np.array(x, "<u4").tobytes(), b"".join(map(self.token, x))) for x in ids]

    def _coded_words(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """The same for pre-tokens, many in a call; the last token of each, and only that, has the mark of a word's end."""
        out, short = {}, []
        for w in words:
            if len(w) > LEAF_CHARS:
                out[w] = self._coded([w])[0]
            else:
                short.append(w)
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) != len(part):
                out.update(zip(part, self._coded(part), strict=True))
                continue
            raw, tokens, x = ids.tobytes(), list(map(self.token, ids.tolist())), 0
            for w, y in zip(part, cuts.tolist(), strict=True):
                out[w] = raw[4 * x : 4 * y], b"".join(tokens[x:y])
                x = y
        return out

    def run(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded UTF-8 text) of each text."""
        out: list[tuple[bytes, bytes]] = []
        seen = self.seen
        for t in texts:
            if not t:
                out.append((b"", b""))
                continue
            if _UNUSUAL.search(t):  # all rules of the normaliser may matter
                coded = self._coded([s for s in _SPACE.split(t) if s])
            else:
                words = _PRETOKEN.findall(t.lower())
                new = [w for w in set(words) if w not in seen]
                if new:
                    if len(seen) + len(new) > REMEMBERED:
                        kept = {w: seen[w] for w in set(words) if w in seen}
                        seen.clear()
                        seen.update(kept)
                    seen.update(self._coded_words(new))
                coded = [seen[w] for w in words]
                for w in new:
                    if len(w) > LEAF_CHARS:
                        del seen[w]
            out.append((b"".join([c[0] for c in coded]), b"".join([c[1] for c in coded])[1:]))
        return out


def encode(docs: DataFrame, tokenizer_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of every row; with keep_ids also ids (array<int>) and decoded."""
    path = tokenizer_path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                coded = codec.run(part.column(1).to_pylist())
                columns = [part.column(0), pa.array([len(x) // 4 for x, _ in coded], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in coded]), pa.array([hashlib.sha256(y).hexdigest() for _, y in coded])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x, _ in coded], pa.list_(pa.int32())), pa.array([y.decode("utf-8") for _, y in coded])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return K.bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + (", ids array<int>, decoded string" if keep_ids else ""))
