"""Byte-level BPE with a frequent-word lexicon compiled into a minimal acyclic transducer.

The corpus's frequent words are counted over all documents, encoded once by exact merging, and
compiled into a minimal acyclic automaton with shared suffixes. Each transition carries the number
of words passed over, so the sum along a path is a word's index, and the index gives its ids. Transitions
lie in one open-addressed table keyed by state and byte. The automaton is one file, sent to each executor
once and memory-mapped there by all its workers.

A text is cut into pieces, and the pieces of many texts walk the automaton together, one byte a step. Every
piece goes through it; those it lacks are merged exactly by rank, all of a stretch together too. The
result never depends on which words are in the lexicon.

Text is cut as by the tokenizer's own pattern. A text without runs of white space is cut at its
spaces and line ends, as pieces between them tokenize independently; any other goes through the pattern.

Defined cases: a null text counts as empty (0 tokens, the hashes of the empty string); texts are
encoded whole, in stretches of bounded size; repeated rows each get a row; ids may be null; other columns are never
read; of pairs of one rank in a word the leftmost is merged first, as the tokenizer does.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import mmap
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: Words compiled into the lexicon at most, and their characters; speed alone depends on them.
LEXICON = 100_000
LONGEST = 64
#: Words counted before a task hands over its sums.
PENDING = 400_000
#: Bytes that walk the automaton together, and bytes of a word from which it is merged by itself.
STRETCH = 1 << 20
LONG_WORD = 256
NEVER = 1 << 60

_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


class Table:
    """Open addressing over whole arrays: distinct keys >= 0 to positions in their array."""

    def __init__(self, slots: np.ndarray, keys: np.ndarray) -> None:
        self.slots, self.keys, self.shift = slots, keys, np.uint64(64 - (len(slots).bit_length() - 1))

    @classmethod
    def of(cls, keys: np.ndarray) -> Table:
        bits = max(4, int(2 * len(keys)).bit_length())
        made = cls(np.full(1 << bits, -1, np.int32), np.asarray(keys, np.int64))
        left = np.arange(len(keys), dtype=np.int32)
        slot = made._home(made.keys)
        while len(left):
            free = made.slots[slot] < 0
            made.slots[slot[free]] = left[free]  # of several that want a slot the last one has it
            out = made.slots[slot] != left
            left, slot = left[out], (slot[out] + 1) & (len(made.slots) - 1)
        return made

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys, -1 where absent."""
        slot = self._home(keys)
        at = self.slots[slot]
        left = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.slots) - 1)
            at[left] = got = self.slots[slot]
            more = (got >= 0) & (self.keys[got] != keys[left])
            left, slot = left[more], slot[more]
        return at


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, back to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, bytes and merge ranks of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_letters()
        ids = spec["model"]["vocab"]
        raw = lambda s: bytes(back[c] for c in s)
        self.token = {i: raw(s) for s, i in ids.items() if all(c in back for c in s)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token |= {i: s.encode() for s, i in self.special.items()}
        self.first = np.array([ids[c] for c, _ in sorted(back.items(), key=lambda x: x[1])], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        #: left id << 20 | right id, in the order of ranks, and what the pair becomes
        self.pairs = Table.of(np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64))
        self.becomes = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, part: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at `at`; NEVER where there is none within the word."""
        both = at < len(part) - 1
        both[both] = owner[at[both]] == owner[at[both] + 1]
        out = np.full(len(at), NEVER, np.int64)
        some = at[both]
        found = self.pairs.find(part[some] << 20 | part[some + 1]).astype(np.int64)
        out[both] = np.where(found >= 0, found, NEVER)
        return out

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the pre-tokens one after the other, and how many each has: always the pair of
        lowest rank is merged, leftmost first, in all words at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        own = {int(i): self._merged_alone(words[i]) for i in np.flatnonzero(sizes > LONG_WORD)}
        raw = np.frombuffer(b"".join([w for i, w in enumerate(words) if i not in own] if own else words), np.uint8)
        part, owner = self.first[raw], np.repeat(np.arange(len(words)), np.where(sizes > LONG_WORD, 0, sizes))
        rank = self.ranks(part, owner, np.arange(len(part)))
        parts = [np.array(ids, np.int64) for ids in own.values()]
        owners = [np.full(len(ids), i) for i, ids in own.items()]
        while len(part):
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(start, append=len(part))
            best = np.minimum.reduceat(rank, start)
            live = best < NEVER
            if not live.all():
                on = np.repeat(live, size)
                parts.append(part[~on])
                owners.append(owner[~on])
                part, owner, rank, size, best = part[on], owner[on], rank[on], size[live], best[live]
                if not len(part):
                    break
            pos = np.flatnonzero(rank == np.repeat(best, size))
            pos = pos[np.concatenate(([True], owner[pos[1:]] != owner[pos[:-1]]))]
            part[pos] = self.becomes[best]
            stays = np.ones(len(part), bool)
            stays[pos + 1] = False
            part, owner, rank = part[stays], owner[stays], rank[stays]
            pos -= np.arange(len(pos))  # each word before lost one part
            before = pos[pos > 0] - 1
            rank[pos] = self.ranks(part, owner, pos)
            rank[before] = self.ranks(part, owner, before)
        part, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parts, owners))
        return part[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _merged_alone(self, word: bytes) -> list[int]:
        """The same for one long word: a heap of pairs over a linked list."""
        part = self.first[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        known: dict[int, int] = {}

        def rank(i: int) -> int:
            j = after[i]
            if j >= len(part):
                return -1
            key = part[i] << 20 | part[j]
            if key not in known:
                known[key] = int(self.pairs.find(np.array([key]))[0])
            return known[key]

        heap = [(r, i) for i in range(len(part)) if (r := rank(i)) >= 0]
        heapq.heapify(heap)
        gone = bytearray(len(part))
        while heap:
            r, i = heapq.heappop(heap)
            if gone[i] or rank(i) != r:
                continue
            j = after[i]
            part[i], gone[j], after[i] = int(self.becomes[r]), 1, after[j]
            if after[j] < len(part):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) >= 0:
                    heapq.heappush(heap, (r, k))
        return [p for p, g in zip(part, gone) if not g]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton over the words as flat arrays in one blob.

    States are merged bottom-up as soon as no later word can reach them (sorted input), so equal
    suffixes share states. Layout: a head of 8 numbers (root; lengths of the arrays; longest word),
    then keys (state << 8 | byte), the table's slots, targets, skips (words before the
    transition), finals, id offsets, ids.
    """
    order = sorted(w for w in words if w)
    register: dict[tuple, int] = {}
    states: list[tuple] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))

    for w in order:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        close(same)
        path.extend([False, []] for _ in w[same:])
        path[-1][0] = True
        last = w
    close(0)
    root = freeze(path[0])
    total = [0] * len(states)
    keys, targets, skips = [], [], []
    for i, (final, out) in enumerate(states):  # children come first
        before = int(final)
        for label, t in out:
            keys.append(i << 8 | label)
            targets.append(t)
            skips.append(before)
            before += total[t]
        total[i] = before
    ids = [words[w] for w in order]
    table = Table.of(np.array(keys, np.int64))
    numbers = [targets, skips, [int(s[0]) for s in states], np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else [0], [i for x in ids for i in x]]
    arrays = [table.keys, table.slots, *(np.asarray(p, np.int32) for p in numbers)]
    head = np.array([root, *map(len, arrays[:2]), *map(len, arrays[4:]), max(map(len, order), default=0), 0], np.int64)
    return b"".join(a.tobytes() for a in (head, *arrays))


class Lexicon:
    """Lookups in a compiled lexicon: of a file, which is memory-mapped, or the blob itself."""

    def __init__(self, source: str | bytes) -> None:
        self.map = source
        if isinstance(source, str):
            with open(source, "rb") as f:
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        root, n_keys, n_slots, self.states, n_start, n_ids, self.longest, _ = np.frombuffer(self.map, np.int64, 8).tolist()
        at = 64

        def view(kind, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.map, kind, n, at)
            at += out.nbytes
            return out

        self.root, keys = root, view(np.int64, n_keys)
        self.table = Table(view(np.int32, n_slots), keys)
        self.target, self.skip, self.final, self.start, self.ids = (view(np.int32, n) for n in (n_keys, n_keys, self.states, n_start, n_ids))

    def find(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The indices of the words at text[start : start + size], -1 for those it lacks."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.table.keys):
            return out
        at = np.flatnonzero((size > 0) & (size <= self.longest))
        state, index, left, here = np.full(len(at), self.root, np.int64), np.zeros(len(at), np.int64), size[at], start[at]
        while len(at):
            edge = self.table.find(state << 8 | text[here])
            on = edge >= 0
            if not on.all():
                at, index, left, here, edge = at[on], index[on], left[on], here[on], edge[on]
            state, index, left, here = self.target[edge].astype(np.int64), index + self.skip[edge], left - 1, here + 1
            ends = left == 0
            if ends.any():
                found = ends & (self.final[state] > 0)
                out[at[found]] = index[found]
                on = ~ends
                at, state, index, left, here = at[on], state[on], index[on], left[on], here[on]
        return out

    def get(self, word: bytes) -> list[int] | None:
        index = int(self.find(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])
        return None if index < 0 else self.ids[self.start[index] : self.start[index + 1]].tolist()


def _flat(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[start : start + size] of all, one after the other."""
    ends = np.cumsum(size)
    return pool[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _starts(raw: bytes) -> np.ndarray:
    """Where the pieces of a stretch without runs of white space begin: at each space, at and after each \n."""
    text = np.frombuffer(raw, np.uint8)
    line = text == 10
    begin = (text == 32) | line
    begin[1:] |= line[:-1]
    begin[0] = True
    return np.flatnonzero(begin)


class Codec:
    """Texts to ids and back. `looked_up` and `found` count pieces that the transducer was asked for and had."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | bytes) -> None:
        self.vocabulary = vocabulary
        self.lexicon = lexicon if isinstance(lexicon, Lexicon) else Lexicon(lexicon)
        self.looked_up = self.found = 0
        size = max(vocabulary.token) + 1
        self.bytes = [vocabulary.token.get(i, b"") for i in range(size)]
        self.decimal = list(map(str, range(size)))
        self.special = {s.encode(): i for s, i in vocabulary.special.items()}

    def stretches(self, text: str) -> Iterator[tuple[bytes, np.ndarray]]:
        """A text's bytes, in stretches of about STRETCH at most, with the starts of their pieces."""
        split = self.vocabulary.splitter
        parts = split.split(text) if split and any(s in text for s in self.vocabulary.special) else [text]
        for part in filter(None, parts):
            if part in self.vocabulary.special:
                yield part.encode(), np.zeros(1, np.int64)
            elif part.split() == part.replace("\n", " ").split(" "):  # each seam stands alone, between words
                at = 0
                while at < len(part):
                    end = part.find(" ", at + STRETCH // 4) if len(part) - at > STRETCH // 4 else -1
                    end = len(part) if end < 0 else end
                    raw = part[at:end].encode("utf-8", "surrogatepass")
                    yield raw, _starts(raw)
                    at = end
            else:
                held, size = [], 0
                for m in PATTERN.finditer(part):
                    held.append(m.group().encode("utf-8", "surrogatepass"))
                    size += len(held[-1])
                    if size >= STRETCH:
                        yield b"".join(held), np.cumsum([0, *map(len, held[:-1])])
                        held, size = [], 0
                if held:
                    yield b"".join(held), np.cumsum([0, *map(len, held[:-1])])

    def coded(self, raw: bytes, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has."""
        size = np.diff(start, append=len(raw))
        index = self.lexicon.find(np.frombuffer(raw, np.uint8), start, size)
        lacks = np.flatnonzero(index < 0)
        self.looked_up += len(start)
        self.found += len(start) - len(lacks)
        place: dict[bytes, int] = {}
        which = np.array([place.setdefault(raw[a : a + n], len(place)) for a, n in zip(start[lacks].tolist(), size[lacks].tolist())], np.int64)
        ids, counts = self.merged(list(place))
        first = np.cumsum(counts) - counts + len(self.lexicon.ids)
        known = np.maximum(index, 0)
        begin = self.lexicon.start[known].astype(np.int64)
        many = self.lexicon.start[np.minimum(known + 1, len(self.lexicon.start) - 1)] - begin
        begin[lacks], many[lacks] = first[which], counts[which]
        return _flat(np.concatenate([self.lexicon.ids, ids]), begin, many), many

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exactly merged pieces: each cut into pre-tokens, and these merged by rank."""
        place: dict[bytes, int] = {}
        tokens, owner, own = [], [], []
        for i, piece in enumerate(pieces):
            if piece in self.special:
                own.append((i, self.special[piece]))
                continue
            word = piece.decode("utf-8", "surrogatepass")
            if (word[1:] if word[0] == " " else word).isalpha():
                tokens.append(place.setdefault(piece, len(place)))
                owner.append(i)
            else:
                for p in PATTERN.findall(word):
                    tokens.append(place.setdefault(p.encode("utf-8", "surrogatepass"), len(place)))
                    owner.append(i)
        ids, counts = self.vocabulary.merged(list(place))
        which = np.array(tokens, np.int64)
        begin, many = (np.cumsum(counts) - counts)[which], counts[which]
        out, sums = _flat(ids, begin, many), np.bincount(np.array(owner, np.int64), many, len(pieces)).astype(np.int64)
        if own:
            at, special = np.array(own).T
            out = np.insert(out, (np.cumsum(sums) - sums)[at], special)
            sums[at] = 1
        return out, sums

    def ids(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, some of its ids) in order; nothing for an empty text."""
        held, size = [], 0

        def walk():
            begin, at = [], 0
            for _, raw, start in held:
                begin.append(start + at)
                at += len(raw)
            ids, counts = self.coded(b"".join(h[1] for h in held), np.concatenate(begin))
            ends = np.cumsum(counts)[np.cumsum([len(h[2]) for h in held]) - 1]
            yield from zip((h[0] for h in held), np.split(ids, ends[:-1]))

        for i, text in enumerate(texts):
            for raw, start in self.stretches(text or ""):
                held.append((i, raw, start))
                size += len(raw)
                if size >= STRETCH:
                    yield from walk()
                    held, size = [], 0
        if held:
            yield from walk()

    def encode(self, text: str | None) -> str:
        """The ids joined by commas."""
        return ",".join(self.decimal[i] for _, ids in self.ids([text]) for i in ids.tolist())

    def decode(self, ids: str) -> str:
        return b"".join([self.bytes[int(i)] for i in ids.split(",")]).decode("utf-8", "replace") if ids else ""

    def digests(self, texts: list) -> dict[str, list]:
        """Number of tokens, hash of the ids, and hash of the text decoded from those ids, for each text."""
        many = [0] * len(texts)
        told, said = ([hashlib.sha256() for _ in texts] for _ in range(2))
        decoder, now = codecs.getincrementaldecoder("utf-8")("replace"), -1
        for i, ids in self.ids(texts):
            some = ids.tolist()
            if i != now:
                if now >= 0:
                    said[now].update(decoder.decode(b"", True).encode("utf-8", "replace"))
                decoder.reset()
                now = i
            told[i].update((("," if many[i] else "") + ",".join([self.decimal[x] for x in some])).encode())
            said[i].update(decoder.decode(b"".join([self.bytes[x] for x in some])).encode("utf-8", "replace"))
            many[i] += len(some)
        if now >= 0:
            said[now].update(decoder.decode(b"", True).encode("utf-8", "replace"))
        return {"n_tokens": many, "ids_sha256": [h.hexdigest() for h in told], "decoded_sha256": [h.hexdigest() for h in said]}


def _counted(batches):
    """Sums of words over a task's texts, handed over whenever PENDING distinct ones are held."""
    kind = pa.schema([("word", pa.string()), ("n", pa.int64())])
    seen: Counter = Counter()

    def hand_over():
        items = list(seen.items())
        for at in range(0, len(items), 50_000):
            some = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], schema=kind)
        seen.clear()

    for b in batches:
        for t in b.column("text").to_pylist():
            seen.update((t or "").split())
            if len(seen) >= PENDING:
                yield from hand_over()
    yield from hand_over()


def frequent_words(docs: DataFrame, n: int = LEXICON) -> list[str]:
    """The most frequent space-delimited words of all texts, at most n: exact sums, of which only
    the largest reach the driver. Words tied at the cut are left out."""
    common.small_batches(docs.sparkSession)
    counts = docs.select("text").mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = common.written(counts.filter(f"n > 1 and length(word) <= {LONGEST}"), "word-counts")
    # How many words there are of each count tells the least count that the n most frequent have; so
    # no task has to send the driver n candidates of its own.
    least, total = 1 << 62, 0
    for count, some in counts.groupBy("n").agg(F.count("*").alias("some")).orderBy(F.desc("n")).limit(n).collect():
        total += some
        if total > n:
            break
        least = count
    words = sorted(r[0] for r in counts.filter(F.col("n") >= least).select("word").collect())
    common.drop_written(counts.sparkSession, counts)
    return words


def lexicon_of(words: list[str], vocabulary: Vocabulary) -> bytes:
    """The words after a space, and their pre-tokens, compiled with their ids."""
    cut = {w: PATTERN.findall(" " + w) for w in words if not any(s in w for s in vocabulary.special)}
    tokens = sorted({p for ps in cut.values() for p in ps})
    raw = [p.encode("utf-8", "surrogatepass") for p in tokens]
    ids, counts = vocabulary.merged(raw)
    of = {p: part.tolist() for p, part in zip(tokens, np.split(ids, np.cumsum(counts)[:-1]))} if tokens else {}
    found = dict(zip(raw, of.values()))
    for w, ps in cut.items():
        found[(" " + w).encode("utf-8", "surrogatepass")] = [i for p in ps for i in of[p]]
    return compile_lexicon(found)


def _sent(spark: SparkSession, content: bytes, label: str) -> str:
    """The name under which each executor finds a file of this content, which it fetches once."""
    name = f"millrace-{label}-{hashlib.sha256(content).hexdigest()[:24]}"
    key = (spark.sparkContext.applicationId, name)
    if key not in _SENT:
        path = Path(tempfile.mkdtemp(prefix="millrace-")) / name  # the driver's own copy, which it serves
        path.write_bytes(content)
        spark.sparkContext.addFile(str(path))
        _SENT.add(key)
    return name


_SENT: set[tuple[str, str]] = set()


def coded(docs: DataFrame, path: str, out: str = "bpe") -> DataFrame:
    """docs with a struct column `out`: n_tokens, the hash of the ids, and the hash of the text
    decoded from those ids. `path`: the tokenizer file, which only the driver reads."""
    spark = docs.sparkSession
    common.small_batches(spark)
    tokenizer = _sent(spark, Path(path).read_bytes(), "tokenizer")
    lexicon = _sent(spark, lexicon_of(frequent_words(docs), Vocabulary(path)), "lexicon")
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    udf = common.text_struct(lambda: _codec(tokenizer, lexicon).digests, schema, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return docs.withColumn(out, udf(F.col("text")))


_CODECS: dict = {}


def _codec(tokenizer: str, lexicon: str) -> Codec:
    """One codec for a worker, kept from task to task; one lexicon at a time."""
    if (tokenizer, lexicon) not in _CODECS:
        _CODECS.clear()
        _CODECS[tokenizer, lexicon] = Codec(Vocabulary(SparkFiles.get(tokenizer)), Lexicon(SparkFiles.get(lexicon)))
    return _CODECS[tokenizer, lexicon]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded(docs, tokenizer_path()).select("doc_id", "bpe.*")
