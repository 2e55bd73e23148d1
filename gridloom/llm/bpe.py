"""BPE encoding and decoding by speculation: greedy longest matches, verified pair by pair, exact merging where that fails.

Works on tokenizer files of the word-end kind: NFC, lower case, a splitting pattern, byte symbols, a word-end suffix.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import lean, small_batches, table

#: Runs of characters that a worker remembers (about 250 bytes each).
CACHE_RUNS = 500_000
#: White space to Python's split(), but not to the pattern.
_UNWHITE = re.compile("[\x1c-\x1f]").search
#: A full stop or comma that the pattern groups with what stands before it.
_GROUPED = re.compile(r"(?:[^\w\s]|_)[,.]\s").search
_END = 256  # the code of the word end, after those of the bytes
_BASE, _MASK = 0xD1342543DE82EF95, (1 << 64) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Table:
    """A fixed map from 64-bit keys to numbers with vectorised look-up (open addressing); absent keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.values[slot[left]] < 0]
            at = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[at]], self.values[slot[at]] = keys[at], values[at]
            left = np.setdiff1d(left, at, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        off = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        while len(off):
            slot[off] = (slot[off] + 1) & ((1 << self.bits) - 1)
            out[off] = self.values[slot[off]]
            off = off[(self.keys[slot[off]] != keys[off]) & (out[off] >= 0)]
        return out


class Tokenizer:
    """Vocabulary and merges of one tokenizer file, with the tables that propose and verify tokens."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or spec["decoder"] is not None:
            raise ValueError("only BPE files with a word-end suffix and no decoder are read")
        suffix, code = model["end_of_word_suffix"], {s: b for b, s in enumerate(byte_symbols())}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.strings = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.spoken = {str(i): s for i, s in self.strings.items()}
        self.size = max(self.strings) + 1
        ids = {s: i for s, i in model["vocab"].items() if s not in self.special}
        #: Ids of single bytes, inside a word and at its end.
        self.inner, self.final = (np.array([ids[s + x] for s in byte_symbols()]) for x in ("", suffix))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        a, b, self.made = (np.array([ids[s] for s in x], np.int64) for x in (*zip(*pairs, strict=True), [a + b for a, b in pairs]))
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.left[self.made], self.right[self.made] = a, b
        #: Order in which symbols come into being: bytes -1, merged ones the number of their merge.
        self.born = np.full(self.size, -1)
        self.born[self.made] = np.arange(len(self.made))
        self.speculative = len(np.unique(self.made)) == len(self.made)  # else a token has two histories, and no proposal is trusted
        self.ranks = Table(self._pair(a, b), np.arange(len(a), dtype=np.int32))
        # tokens as codes: bytes, and _END for the word end; those that do not encode to themselves are never proposed
        tokens = {i: [*map(code.__getitem__, s.removesuffix(suffix)), *[_END] * s.endswith(suffix)] for s, i in ids.items()}
        whole = [i for i, c in tokens.items() if c[-1] == _END]
        part = [i for i, c in tokens.items() if c[-1] != _END]
        merged = self.merge([bytes(tokens[i][:-1]) for i in whole]) + self.merge([bytes(tokens[i]) for i in part], ended=False)
        stable = [i for i, m in zip(whole + part, merged, strict=True) if m == [i]]
        self._tokens = [np.array(tokens.get(i, []), np.uint64) for i in range(self.size)]
        known: dict[int, int] = {}
        for i in stable:
            h = 0
            for c in tokens[i]:
                h = (h * _BASE + c + 1) & _MASK
                known.setdefault(h, 0)
            known[h] = i + 1
        #: Hashes of the tokens' beginnings: 0, or one more than the id where a token ends.
        self.starts = Table(np.array(list(known), np.uint64), np.array(list(known.values()), np.int32))
        self._encoder: Encoder | None = None

    def decode(self, ids: str) -> str:
        """As a tokenizer without a decoder does: the strings of the tokens, joined by one space. Unknown ids are left out."""
        if not ids:
            return ""
        listed = ids.split(" ")
        try:
            return " ".join(map(self.spoken.__getitem__, listed))
        except KeyError:
            return " ".join(self.spoken[i] for i in listed if i in self.spoken)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def encoder(self) -> Encoder:
        """The encoder of this process; a worker keeps it, and what it has learned, from task to task."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoder": None}

    def merge(self, words: list[bytes], ended: bool = True) -> list[list[int]]:
        """Exact encoding of all words side by side: in each, the earliest merge first, the leftmost of equals."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids, owner = self.inner[raw], np.repeat(np.arange(len(words)), size)
        if ended:
            last = np.cumsum(size)[size > 0] - 1
            ids[last] = self.final[raw[last]]
        none = len(self.made)
        out: list[list[int]] = [[] for _ in words]

        def ranked(at: np.ndarray) -> np.ndarray:
            """Ranks of the pairs that begin at these places; `none` for no merge and at a word's end."""
            inside = at + 1 < len(ids)
            nxt = np.where(inside, at + 1, 0)
            r = self.ranks.get(self._pair(ids[at], ids[nxt]))
            return np.where(inside & (owner[at] == owner[nxt]) & (r >= 0), r, none)

        rank = ranked(np.arange(len(ids)))
        while len(ids):
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            length = np.diff(np.append(begin, len(ids)))
            least = np.minimum.reduceat(rank, begin)
            done = least == none
            if done.any():
                flat, at = ids.tolist(), 0
                for k, n in zip(owner[begin[done]].tolist(), zip(begin[done].tolist(), length[done].tolist(), strict=True), strict=True):
                    at, n = n
                    out[k] = flat[at : at + n]
                keep = np.repeat(~done, length)
                ids, owner, rank, least, length = ids[keep], owner[keep], rank[keep], least[~done], length[~done]
                if not len(ids):
                    break
            join = rank == np.repeat(least, length)
            at = np.flatnonzero(join)
            run = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # of merges that overlap, every other one takes place
            at = at[(at - np.repeat(at[run], np.diff(np.append(run, len(at))))) % 2 == 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            rank[at] = ranked(at)
            before = at[at > 0] - 1
            rank[before] = ranked(before)
        return out

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left, (tokens, word of each), for all words side by side. The word end is never left
        over alone; a word at some place of which nothing matches ends with -1."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        codes = np.full(int(size.sum()), _END, np.uint64)
        stop = np.cumsum(size)
        inside = np.ones(len(codes), bool)
        inside[stop - 1] = False
        codes[inside] = np.frombuffer(b"".join(words), np.uint8)
        end = np.repeat(stop, size)
        token, reach = np.full(len(codes), -1), np.zeros(len(codes), np.int64)
        live, h, n = np.arange(len(codes)), np.zeros(len(codes), np.uint64), 0
        while len(live):
            h = h * np.uint64(_BASE) + codes[live + n] + np.uint64(1)
            n += 1
            found = self.starts.get(h)
            full = (found > 0) & (live + n != end[live] - 1)
            token[live[full]], reach[live[full]] = found[full] - 1, n
            more = (found >= 0) & (live + n < end[live])
            live, h = live[more], h[more]
        tokens, owners = [], []
        at, word = stop - size, np.arange(len(words))
        while len(at):
            tokens.append(token[at])
            owners.append(word)
            more = (token[at] >= 0) & (at + reach[at] < stop[word])
            at, word = (at + reach[at])[more], word[more]
        tokens, owners = np.concatenate(tokens or [np.zeros(0, int)]), np.concatenate(owners or [np.zeros(0, int)])
        order = np.argsort(owners, kind="stable")
        tokens, owners = tokens[order], owners[order]
        good = np.ones(len(words), bool)
        good[owners[tokens < 0]] = False
        spelled = np.concatenate([*map(self._tokens.__getitem__, tokens[good[owners]].tolist()), np.zeros(0, np.uint64)])
        if not np.array_equal(spelled, codes[np.repeat(good, size)]):  # two strings with one hash: propose nothing
            return np.full(len(words), -1), np.arange(len(words))
        return tokens, owners

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbouring tokens: whether the text of both encodes to just these two.

        Takes both tokens apart from the later born to the earlier and looks, at the seam, for a merge that would have
        come before the seam's symbols became part of what they are now.
        """
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), len(self.made), np.int64)  # merges before this one may cross the seam
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank = self.ranks.get(self._pair(x, y))
            crosses = (rank >= 0) & (rank < limit[live])
            ok[live[crosses]] = False
            live, x, y = live[~crosses], x[~crosses], y[~crosses]
            bx, by = self.born[x], self.born[y]
            more = np.maximum(bx, by) >= 0
            live, x, y, bx, by = live[more], x[more], y[more], bx[more], by[more]
            from_left = bx >= by  # of one age, the left one was merged no later at the seam
            limit[live] = np.where(from_left, bx, by + 1)
            a[live] = np.where(from_left, self.right[x], x)
            b[live] = np.where(from_left, y, self.left[y])
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of words in UTF-8; only words that fail the checks are merged."""
        if not self.speculative:
            return self.merge(words)
        tokens, owner = self.greedy(words)
        bad = np.zeros(len(words), bool)
        bad[owner[tokens < 0]] = True
        seam = np.flatnonzero((owner[1:] == owner[:-1]) & ~bad[owner[:-1]])
        bad[owner[seam[~self.compatible(tokens[seam], tokens[seam + 1])]]] = True
        begin = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        flat = tokens.tolist()
        out = [flat[a:z] for a, z in zip(begin, begin[1:], strict=False)]
        failed = np.flatnonzero(bad).tolist()
        self.failed = len(failed)
        for k, ids in zip(failed, self.merge([words[k] for k in failed]), strict=True):
            out[k] = ids
        return out


class Cache:
    """A mapping of bounded size in two generations: what is used stays, the rest goes when the younger one is full."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size // 2, {}, {}

    def missing(self, keys: set[str]) -> set[str]:
        """Keys to be learned. Those known are in `young` afterwards."""
        absent = keys.difference(self.young)
        if len(self.young) + len(absent) > self.size:
            self.old, self.young, absent = self.young, {}, keys
        again = absent & self.old.keys()
        self.young.update((k, self.old[k]) for k in again)
        return absent - again


class Encoder:
    """Encodes whole texts with one tokenizer, remembering runs of non-white characters in a bounded cache."""

    def __init__(self, tokenizer: Tokenizer):
        self.t = tokenizer
        white = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.find = regex.compile(tokenizer.pattern.replace(r"\s", white)).findall
        self.split = re.compile(f"[^{white}]+").findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(tokenizer.special, key=len, reverse=True))) + ")") if tokenizer.special else None
        self.hints = {s[:2] for s in tokenizer.special}
        self.names = list(map(str, range(tokenizer.size)))
        self.known, self.blanks = Cache(CACHE_RUNS), False

    def _split_run(self, run: str) -> list[str]:
        """The words of a run; no match of the pattern holds white space or looks beyond the run's ends."""
        if not run.isascii() and any(unicodedata.category(c) == "Cn" for c in run):
            return self._newer(run)
        low = unicodedata.normalize("NFC", run).replace("\u03a3", "\u03c3").lower()
        if low.isalpha():  # exactly the letters
            return [low]
        if low[-1:] in (".", ",") and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.find(low)

    def _newer(self, run: str) -> list[str]:
        """As _split_run, for characters that Python's Unicode tables don't know and the tokenizers library's may."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        low = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(run)
        return [w for w, _ in pre_tokenizers.Split(Regex(self.t.pattern), "removed", invert=True).pre_tokenize_str(low)]

    def _learn(self, runs: set[str]) -> None:
        parts = {r: self._split_run(r) for r in self.known.missing(runs)}
        words = list({w for p in parts.values() for w in p})
        names = self.names.__getitem__
        spelled = {w: " ".join(map(names, ids)) for w, ids in zip(words, self.t.encode_words([w.encode() for w in words]), strict=True)}
        young = self.known.young
        for r, p in parts.items():
            if len(p) == 1:
                young[r] = spelled[p[0]]
            else:
                young[r] = " ".join([spelled[w] for w in p])
                self.blanks |= not p

    def _runs_of(self, text: str) -> list[str]:
        """The text between white space; full stops and commas after a word, and before white space, are apart as they
        are for the pattern, unless one of them follows something that it would be grouped with."""
        if _UNWHITE(text):
            return self.split(text)
        if not _GROUPED(text):
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
        return text.split()

    def _plain(self, texts: list[str]) -> Iterator[str]:
        """Ids, joined by spaces, of texts without special tokens."""
        split = [self._runs_of(t) for t in texts]
        runs = set().union(*split)
        most = CACHE_RUNS // 4
        if len(runs) > most and len(texts) > 1:
            for t in texts:
                yield from self._plain([t])
            return
        if len(runs) > most:  # one text with more different runs than the cache holds: in parts
            words = split[0]
            yield " ".join(filter(None, (next(self._plain([" ".join(words[k : k + most])])) for k in range(0, len(words), most))))
            return
        self._learn(runs)
        known = self.known.young.__getitem__
        for words in split:
            got = map(known, words)
            yield " ".join(filter(None, got) if self.blanks else got)  # a run without tokens leaves no space behind

    def _pieces(self, text: str) -> list[str]:
        """Text and special tokens in turn; a text without the latter is one piece."""
        return self.specials.split(text) if self.specials and any(h in text for h in self.hints) else [text]

    def batch(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, ids joined by spaces, text decoded from those ids) of each text."""
        for group in self._groups(texts):
            pieces = [self._pieces(t or "") for t in group]
            plain = self._plain([x for p in pieces for x in p[::2]])
            for p in pieces:
                ids = " ".join(filter(None, [str(self.t.special[piece]) if k % 2 else next(plain) for k, piece in enumerate(p)]))
                yield ids.count(" ") + 1 if ids else 0, ids, self.t.decode(ids)

    @staticmethod
    def _groups(texts: list[str | None], most: int = 1 << 20) -> Iterator[list[str | None]]:
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t or "")
            if size >= most:
                yield group
                group, size = [], 0
        if group:
            yield group


def _encoded(docs: DataFrame, file: str, id_col: str, text_col: str, give, schema: str) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Tokenizer(file))  # a few MB, whatever the corpus

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder()
        for b in batches:
            columns = list(zip(*map(give, encoder.batch(b.column(1).to_pylist())), strict=True)) or [[]] * schema.count(",")
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, {"long": pa.int64(), "string": pa.string()}[t.split()[1]]) for c, t in zip(columns, schema.split(", ")[1:], strict=True))], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(scan), schema.replace("any", rows.schema["id"].dataType.simpleString())).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids as decimal numbers joined by spaces, decoded text) of every row; a null text counts as empty.

    Empty texts have no tokens. Repeated rows are encoded as often as they come; other columns are not read.
    """
    return _encoded(docs, file, id_col, text_col, lambda x: x, "id any, n_tokens long, ids string, decoded string")


def decode(encoded: DataFrame, file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids as decimal numbers joined by spaces. Null ids give an empty text."""
    spark = encoded.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Tokenizer(file))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.decode(x or "") for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), ids_col)
    return rows.mapInArrow(lean(scan), f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def _digest(x: tuple[int, str, str]) -> tuple[int, str, str]:
    return x[0], hashlib.sha256(x[1].encode()).hexdigest(), hashlib.sha256(x[2].encode()).hexdigest()


def encode_digests(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), with SHA-256 digests of the ids and of the decoded text in their place."""
    return _encoded(docs, file, id_col, text_col, _digest, "id any, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_file())


QUERIES = {"op4_bpe": op4_bpe}
SQL: dict[str, str] = {}
