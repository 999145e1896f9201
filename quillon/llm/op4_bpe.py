"""Byte-pair encoding and decoding by a prefix-sharing trie.

The distinct new words of a stretch of texts are inserted into a trie. A depth-first walk gives every
node its state: the last token of the encoding of the prefix that the node spells, and the node where
that token begins. A token t may follow a token s exactly if merging s + t by the ranks yields
[s, t] again, and every prefix has one last token that may follow what stands before it; so
the state of a node follows from the states above it, and a prefix that many words share is encoded once.
The end of a word is one more step, whose tokens carry the end-of-word mark.

Words are cut as the tokenizer file says (NFC, lower case, pattern); special tokens in a text keep
their ids. Files of this kind only: BPE with an end-of-word suffix, byte-level alphabet, no decoder.

Null and empty texts: no tokens, and the hashes of nothing. Very long words and texts are encoded whole. Null
doc_ids and repeated rows are passed through. Empty table: no rows. Clashing further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, kept, small_batches, table

#: Bytes of encodings after which a worker's cache starts a new generation (the one before stays in reach), and what a word takes besides its own bytes.
CACHE_BYTES, WORD_BYTES = 46 << 20, 200
#: Pairs of tokens that a worker remembers to go together or not.
CACHE_PAIRS = 1 << 19
#: Bytes of text whose distinct words share a trie.
STRETCH = 1 << 20
#: Words of more symbols than this are walked alone, as they share no prefix worth a node.
LONG = 1 << 12
KEPT = "op4"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CODED = "doc_id long, ids array<int>, decoded string"


def alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable, else the next free code point from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PrefixTrie:
    """Encodes words; a word is a string of byte stand-ins."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.ranks = {pair: k for k, pair in enumerate(merges)}
        #: Lengths of the tokens that end in two given symbols, the longest first; 1 is always among them.
        sizes: dict[str, set[int]] = {}
        for token in vocab:
            body, mark = (token[: -len(end)], end) if token.endswith(end) and token != end else (token, "")
            sizes.setdefault(body[-2:] + mark, {1}).add(len(body))
        self.lengths = {k: sorted(v, reverse=True) for k, v in sizes.items()}
        #: Symbols of the longest token: no step looks further back.
        self.reach = max(map(len, vocab), default=1)
        self.follows: dict[tuple[str, str], bool] = {}
        self.spines: dict[tuple[str, bool], list] = {}
        self.trees: dict[str, tuple] = {}

    def merged(self, parts: list[str]) -> list[str]:
        """The parts after all merges, the lowest rank first and from the left."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get((parts[k], parts[k + 1]), 1 << 30), k) for k in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def spine(self, token: str, right: bool) -> list[tuple[str, int, int]]:
        """The pieces at the right (else left) edge of a token while it is merged from its symbols:
        piece, when it is there, when it is merged away. Time is the highest rank merged so far."""
        known = self.spines.get((token, right))
        if known is None:
            whole, t = self._tree(token)
            known = []
            death = 1 << 30
            while True:
                known.append((whole[0], t, death))
                if len(whole) == 1:
                    break
                death = t
                whole = whole[2 if right else 1]
                t = self._tree(whole[0])[1]
            self.spines[(token, right)] = known = known[::-1]
        return known

    def _tree(self, token: str):
        """How a token is merged: (token, left, right) or (token,), and the highest rank in it; rank -1: it isn't."""
        known = self.trees.get(token)
        if known is None:
            parts = [((x,), 0) for x in self.symbols(token)]
            while len(parts) > 1:
                rank, at = min((self.ranks.get((parts[k][0][0], parts[k + 1][0][0]), 1 << 30), k) for k in range(len(parts) - 1))
                if rank == 1 << 30:
                    break
                (x, tx), (y, ty) = parts[at : at + 2]
                made = ((x[0] + y[0], x, y), max(rank, tx, ty))
                self.trees.setdefault(made[0][0], made)
                parts = [*parts[:at], made, *parts[at + 2 :]]
            known = self.trees[token] = parts[0] if len(parts) == 1 else ((token,), -1)
        return known

    def may_follow(self, last: str, token: str) -> bool:
        """Whether the encoding of last + token is [last, token]; last is "" at the start of a word."""
        known = self.follows.get((last, token))
        if known is None:
            if len(self.follows) >= CACHE_PAIRS:
                self.follows.clear()
            known = self.follows[last, token] = self._apart(last, token)
        return known

    def _apart(self, last: str, token: str) -> bool:
        if self._tree(token)[1] < 0:
            return False
        if not last:
            return True
        ends, heads, i, j = self.spine(last, True), self.spine(token, False), 0, 0
        while True:
            (x, tx, gone_x), (y, ty, gone_y) = ends[i], heads[j]
            rank = self.ranks.get((x, y))
            if rank is not None:
                when, gone = max(rank, tx, ty), min(gone_x, gone_y)
                if when < gone:
                    return False
                if when == gone:  # the order within one rank decides: merge the symbols themselves
                    return self.merged(self.symbols(last) + self.symbols(token)) == [last, token]
            if gone_x == gone_y:
                if gone_x == 1 << 30:
                    return True
                return self.merged(self.symbols(last) + self.symbols(token)) == [last, token]
            if gone_x < gone_y:
                i += 1
            else:
                j += 1

    def encode(self, words: list[str]) -> dict[str, list[str]]:
        """The tokens of each word, in time and memory that grow with the symbols."""
        children: list[dict[str, int]] = [{}]
        ends: dict[int, list[str]] = {}
        out: dict[str, list[str]] = {}
        for word in words:
            if len(word) > LONG:
                out[word] = self._alone(word)
                continue
            node = 0
            for c in word[:-1]:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                node = nxt
            ends.setdefault(node, []).append(word)
        last, begin = [""] * len(children), [0] * len(children)
        stack: list[tuple[int, str]] = [(0, "")]  # node and the symbols it spells: LONG of them at most
        path: list[int] = []
        while stack:
            node, prefix = stack.pop()
            depth = len(prefix)
            del path[depth:]
            path.append(node)
            if depth:
                last[node], begin[node] = self._step(prefix, depth, path, last, "")
            for word in ends.get(node, ()):
                token, at = self._step(word, depth + 1, path, last, self.end)
                out[word] = self._traced(token, at, last, begin)
            for c, child in children[node].items():
                stack.append((child, prefix + c))
        return out

    def _alone(self, word: str) -> list[str]:
        """The tokens of one word: a walk along its own prefixes, whose nodes are their lengths."""
        n, reach = len(word), self.reach
        last, begin = [""] * n, [0] * n
        for depth in range(1, n):
            last[depth], begin[depth] = self._step(word[max(0, depth - reach) : depth], depth, range(n), last, "")
        return self._traced(*self._step(word[max(0, n - reach) :], n, range(n), last, self.end), last, begin)

    @staticmethod
    def _traced(token: str, at: int, last: list[str], begin: list[int]) -> list[str]:
        tokens = [token]
        while at:
            tokens.append(last[at])
            at = begin[at]
        return tokens[::-1]

    def _step(self, tail: str, depth: int, path: Sequence[int], last: list[str], end: str) -> tuple[str, int]:
        """The last token of the first depth symbols, which end in tail, and the node before it. path: the nodes of the shorter prefixes."""
        follows, n = self.follows, len(tail)
        for long in self.lengths.get(tail[-2:] + end, (1,)):
            if long <= n:
                token = tail[n - long :] + end
                if token in self.vocab:
                    before = last[path[depth - long]]
                    known = follows.get((before, token))
                    if known or known is None and self.may_follow(before, token):
                        return token, path[depth - long]
        raise ValueError(f"no token for {tail[-1]!r}")


class Coder:
    """Encoding and decoding as the tokenizer file at path defines them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None:
            raise ValueError(f"{path} isn't a BPE tokenizer with word ends and without a decoder")
        self.vocab = model["vocab"]
        self.trie = PrefixTrie(self.vocab, [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.bytes = str.maketrans(dict(enumerate(alphabet())))
        self.little = {t: i.to_bytes(4, "little") for t, i in self.vocab.items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.pattern.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if self.parts is None or "<|" not in text:
            return self.words(text)
        return [w for k, part in enumerate(self.parts.split(text)) for w in ([part] if k % 2 else self.words(part))]

    def learn(self, pieces: set[str]) -> None:
        """Sees to it that all the pieces are known. Of the words of earlier texts those go first that haven't come up for long."""
        known, older = self.known, self.older
        fresh = {}
        for w in pieces:
            if w not in known:
                if w in older:
                    self._hold(w, older[w])
                elif w in self.special:
                    self._hold(w, self.special[w].to_bytes(4, "little"))
                else:
                    fresh[w] = w if w.isascii() and w.isprintable() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.bytes)
        coded = self.trie.encode(sorted(set(fresh.values())))
        little = self.little
        for word, spelled in fresh.items():
            self._hold(word, b"".join([little[t] for t in coded[spelled]]))

    def _hold(self, word: str, ids: bytes) -> None:
        self.known[word] = ids
        self.held += WORD_BYTES + len(word) + len(ids)

    def forget(self) -> None:
        """Starts a new generation when the cache is full."""
        if self.held > CACHE_BYTES:
            self.known, self.older, self.held = {}, self.known, 0

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def joined(self, ids: bytes) -> str:
        """decode, of little-endian unsigned 32-bit ids that all have a token."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def coder(path: str) -> Coder:
    """The coder of a file, one per worker process, with what it has learned from earlier tasks."""
    return kept((KEPT, path), lambda: Coder(path))


def _coded(path: str, batches: Iterator[pa.RecordBatch]):
    own = coder(path)
    for piece in chunks(batches, "text", STRETCH, KEPT):
        texts = [own.pieces(t) if t else [] for t in piece.column("text").to_pylist()]
        own.learn(set().union(*texts))
        known = own.known
        for doc_id, pieces in zip(piece.column("doc_id").to_pylist(), texts, strict=True):
            ids = b"".join([known[p] for p in pieces])
            yield doc_id, ids, own.joined(ids)
        own.forget()


def _batches(rows, make, names, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list = []
    for row in rows:
        held.append(make(row))
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, (_, t) in enumerate(names)], names=[n for n, _ in names])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, (_, t) in enumerate(names)], names=[n for n, _ in names])


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs (doc_id, text)."""
    names = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def make(row):
        return row[0], len(row[1]) // 4, hashlib.sha256(row[1]).hexdigest(), hashlib.sha256(row[2].encode("utf-8", "surrogatepass")).hexdigest()

    return _texts(docs).mapInArrow(lambda batches: _batches(_coded(path, batches), make, names), DIGESTS)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded (their text) of every row of docs (doc_id, text)."""
    names = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]

    def make(row):
        return row[0], memoryview(row[1]).cast("I").tolist(), row[2]

    return _texts(docs).mapInArrow(lambda batches: _batches(_coded(path, batches), make, names, 200), CODED)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of coded (doc_id, ids); null ids: empty text. Ids without a token are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([own.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path())
