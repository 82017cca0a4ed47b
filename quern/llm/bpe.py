"""BPE encoding and decoding by speculation and verification.

Each word is first cut greedily into the longest vocabulary pieces.  Such a
cut is the merge procedure's result exactly when every two neighbours would
also stay apart on their own, so all adjacent pairs of many words are tested
at once with array operations on the merge tree; only words with a failing
pair go through the exact merge procedure.

The vocabulary file's path is a parameter.  Files of the kind with word ends
(lower case, white space dropped) are supported.

Defined cases: a null or empty text has no tokens; strings of special tokens
in a text are encoded as those tokens, as the file's library does; repeated
rows are encoded alike, whatever their doc_id, null included; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import prepare, slices

#: Words whose encoding a worker keeps.
CACHE_WORDS = 400_000
#: Letters up to which a scan beats a heap.
SHORT = 48
#: New words that are encoded together.
BLOCK = 20_000
# White space as the file's normaliser knows it.
BLANKS = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files of byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


# Letters and digits that Python's tables (Unicode 15.1) do not know and the library's do.
NEWER = "1c89-1c8a a7cb-a7ce a7d2 a7d4 a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 16ea0-16eb8 18cff 1e5d0-1e5ed 1e5f0"

# Lower case of capitals among them (from, to, how many in a row).
NEWER_LOWER = {0x1C89: (0x1C8A, 1), 0xA7CB: (0x264, 1), 0xA7CC: (0xA7CD, 1), 0xA7CE: (0xA7CF, 1), 0xA7D2: (0xA7D3, 1), 0xA7D4: (0xA7D5, 1), 0xA7DA: (0xA7DB, 1), 0xA7DC: (0x19B, 1), 0x10D50: (0x10D70, 22), 0x16EA0: (0x16EBB, 25)}
LOWER = {a + k: b + k for a, (b, n) in NEWER_LOWER.items() for k in range(n)}
CAPITALS = regex.compile(f"[{''.join(map(chr, LOWER))}]")


@cache
def later_letters() -> list[str]:
    """Characters that the installed ``regex`` takes for letters or digits and the library does not, as its tables are older."""
    newer = {c for a, _, b in (r.partition("-") for r in NEWER.split()) for c in range(int(a, 16), int(b or a, 16) + 1)}
    unknown = "".join([chr(c) for c in range(0x110000) if c not in newer and unicodedata.category(chr(c)) == "Cn"])
    return regex.findall(r"[\p{L}\p{N}]", unknown)


class Vocabulary:
    """Pieces, merge ranks and the merge tree as arrays."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", BLANKS)
        self.pattern = regex.compile(split)
        # for texts with characters that only later versions of Unicode know as letters or digits
        later = "".join(later_letters())
        self.first_later = later[:1]
        self.with_later = regex.compile(split.replace(r"\p{L}", f"[\\p{{L}}--[{later}]]").replace(r"\p{N}", f"[\\p{{N}}--[{later}]]"), regex.V1) if later else self.pattern
        self.later = regex.compile(f"[{later}]") if later else None
        self.splitter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.letters = byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        size = max(self.ids.values()) + 1
        # rank of the merge that makes a token; single letters have -1
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        keys, made = [], []
        for r, (a, b) in enumerate(merges):
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.ranks.setdefault((i, j), (r, k))
            keys.append(i * size + j)
            made.append(r)
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.size, self.pair_keys, self.pair_ranks = size, np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.sound = self._sound()
        self.pieces = {t: i for t, i in self.ids.items() if self.sound[i]}
        #: the longest piece by its first two letters
        self.reach: dict[str, int] = {}
        for t in self.pieces:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        self.by_pair = {i * size + j: r for (i, j), (r, _) in self.ranks.items()}
        self.made = [self.ids[a + b] for a, b in merges]

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a and b, or a very large number."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.int64(1) << 60)

    def compatible(self, a: np.ndarray, b: np.ndarray, whole: bool = True) -> np.ndarray:
        """For each pair of tokens: does merging leave a boundary between them?

        The pieces next to the boundary are, over time, those on a's right edge
        and b's left edge in the merge tree; each lasts until the merge of its
        parent.  Walking back from the whole tokens, a boundary is lost if two
        such pieces merge before either parent does (of equal merges, the one
        more to the left comes first).  ``whole`` False leaves the merge of a
        and b themselves out of account.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        far = np.int64(1) << 59
        end_a, end_b = np.full(len(a), far), np.full(len(a), far)
        fine, open_ = np.ones(len(a), bool), np.arange(len(a))
        first = True
        while len(open_):
            x, y, ex, ey = a[open_], b[open_], end_a[open_], end_b[open_]
            r = self._merge_rank(x, y)
            lost = (r < ex) & (r <= ey) & (r < far)
            if first and not whole:
                lost[:] = False
            first = False
            fine[open_[lost]] = False
            rx, ry = self.rank[x], self.rank[y]
            back_a = rx > ry  # the later of the two edges' last merges is undone first
            both = rx == ry
            back_a |= both & (rx >= 0)
            done = lost | ((rx < 0) & (ry < 0))
            step_a, step_b = open_[back_a & ~done], open_[~back_a & ~done]
            end_a[step_a] = self.rank[a[step_a]]
            a[step_a] = self.right[a[step_a]]
            end_b[step_b] = self.rank[b[step_b]]
            b[step_b] = self.left[b[step_b]]
            open_ = open_[~done]
        return fine

    def _sound(self) -> np.ndarray:
        """Tokens that the merge procedure makes of their own letters."""
        out = np.zeros(self.size, bool)
        out[[i for i in self.ids.values()]] = True
        made = np.flatnonzero(self.rank >= 0)
        out[made] = self.compatible(self.left[made], self.right[made], whole=False)
        for k in made[np.argsort(self.rank[made])]:
            out[k] = out[k] and out[self.left[k]] and out[self.right[k]]
        single = [i for t, i in self.ids.items() if self.rank[i] < 0 and len(t.removesuffix(self.suffix) if t != self.suffix else t) > 1]
        out[single] = False
        return out

    def greedy(self, word: str) -> list[int]:
        """Longest pieces from the left; the last carries the word end."""
        out, at, n, pieces, reach, end = [], 0, len(word), self.pieces.get, self.reach.get, len(self.suffix)
        whole = word + self.suffix
        while at < n:
            far = at + reach(whole[at : at + 2], 1)
            if far >= n + end:
                got = pieces(whole[at:])
                if got is not None:
                    out.append(got)
                    return out
            # a last single letter must take the end with it, so a piece without it stops before
            for to in range(min(n - 1, far), at, -1):
                got = pieces(whole[at:to])
                if got is not None:
                    break
            else:
                got = pieces(whole[at:])
                return [*out, got] if at == n - 1 and got is not None else []
            out.append(got)
            at = to
        return out

    def exact(self, word: str) -> list[int]:
        """The merge procedure: the lowest rank first, of equal ranks the leftmost; a plain scan of short words, for long ones a heap over a linked list."""
        part = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.suffix]]
        n = len(part)
        if n <= SHORT:
            size, by_pair, made = self.size, self.by_pair.get, self.made
            far = len(made)
            rank = [by_pair(x * size + y, far) for x, y in zip(part, part[1:])]
            while rank and (r := min(rank)) < far:
                i = rank.index(r)
                part[i : i + 2] = [made[r]]
                del rank[i]
                if i < len(rank):
                    rank[i] = by_pair(part[i] * size + part[i + 1], far)
                if i:
                    rank[i - 1] = by_pair(part[i - 1] * size + part[i], far)
            return part
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.ranks[p], i, *p) for i in range(n - 1) if (p := (part[i], part[i + 1])) in self.ranks]
        heap = [(r, i, k, x, y) for r, k, i, x, y in heap]
        heapq.heapify(heap)
        while heap:
            _, i, k, x, y = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if part[i] != x or j >= n or part[j] != y:
                continue
            part[i], part[j] = k, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (got := self.ranks.get((part[p], part[q]))):
                    heapq.heappush(heap, (got[0], p, got[1], part[p], part[q]))
        return [p for p in part if p is not None]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Words in byte letters, not empty."""
        cut = [self.greedy(w) for w in words]
        n = np.array([len(c) for c in cut], np.int64)
        flat = np.array([t for c in cut for t in c], np.int64)
        owner = np.repeat(np.arange(len(cut)), n)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        wrong = set(owner[inner[~self.compatible(flat[inner], flat[inner + 1])]].tolist()) if len(inner) else set()
        wrong |= set(np.flatnonzero(n == 0).tolist())
        for i in wrong:
            cut[i] = self.exact(words[i])
        return cut

    def _pieces(self, text: str) -> list[str]:
        odd = self.later is not None and not text.isascii() and max(text) >= self.first_later and self.later.search(text)
        return (self.with_later if odd else self.pattern).findall(text)

    def normalised(self, text: str) -> str:
        """NFC, then lower case letter by letter (no final sigma)."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        if not text.isascii() and max(text) >= "\u1c89" and CAPITALS.search(text):
            text = text.translate(LOWER)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def words(self, text: str) -> list[str]:
        """The text's words, and special tokens as they stand."""
        if self.splitter is None or "<" not in text:
            return self._pieces(self.normalised(text))
        out, at = [], 0
        for m in self.splitter.finditer(text):
            out += self._pieces(self.normalised(text[at : m.start()]))
            out.append(m[0])
            at = m.end()
        return out + self._pieces(self.normalised(text[at:]))

    def decode(self, ids) -> str:
        """The tokens' strings, as the library joins them where the file names no decoder."""
        return " ".join(self.tokens[int(i)] for i in ids)

    def text_of(self, ids) -> str:
        """The words back as text, one space between them (special tokens as they stand)."""
        back, special, out, word = {c: b for b, c in enumerate(self.letters)}, set(self.special.values()), [], bytearray()
        for i in map(int, ids):
            t = self.tokens[i]
            if i in special:
                out.append(t)
                continue
            word += bytes(back[c] for c in t.removesuffix(self.suffix))
            if t.endswith(self.suffix):
                out.append(bytes(word).decode("utf-8", "replace"))
                word = bytearray()
        return " ".join(out + ([bytes(word).decode("utf-8", "replace")] if word else []))


class Encoder:
    """A vocabulary with a bounded cache: a word's ids as bytes, and its tokens' strings as bytes."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        special = self.vocabulary.special
        self.fixed = {t: (int(i).to_bytes(4, "little"), t.encode()) for t, i in special.items()}

    def learn(self, words: set[str]) -> None:
        v = self.vocabulary
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known = {}
        self.known |= self.fixed
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), BLOCK):
            block = new[at : at + BLOCK]
            spelt = ["".join([v.letters[b] for b in w.encode()]) for w in block]
            for w, ids in zip(block, v.encode_words(spelt), strict=True):
                self.known[w] = pack(f"<{len(ids)}I", *ids), " ".join([v.tokens[i] for i in ids]).encode()

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit numbers, decoded text) of each."""
        split = [self.vocabulary.words(t) for t in texts]
        self.learn({w for ws in split for w in ws})
        out = []
        for ws in split:
            got = [self.known[w] for w in ws]
            out.append((b"".join([i for i, _ in got]), b" ".join([d for _, d in got])))
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, token_ids of every row; with ``digests``, hashes of the ids and of the decoded text instead of the ids."""
    prepare(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for part in slices(batches):
            got = own.encode([t or "" for t in part.column("text").to_pylist()])
            n = pa.array([len(i) // 4 for i, _ in got], pa.int64())
            if digests:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, pa.array([hashlib.sha256(i).hexdigest() for i, _ in got]), pa.array([hashlib.sha256(d).hexdigest() for _, d in got])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                flat = np.frombuffer(b"".join([i for i, _ in got]), "<u4").astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(i) // 4 for i, _ in got])]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, ids], names=["doc_id", "n_tokens", "token_ids"])

    out = [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType())]
    out += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else [T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(out))


def decode(encoded: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """doc_id and the words of ``token_ids`` joined by single spaces."""
    prepare(encoded.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(path).vocabulary
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([v.text_of(x or ()) for x in part.column("token_ids").to_pylist()], pa.string())], names=["doc_id", column])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField(column, T.StringType())]))
