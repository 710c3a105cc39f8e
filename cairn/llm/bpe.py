"""Byte-level BPE encoding and decoding by recursive queries of an embedded DuckDB in each partition.

A word (a match of the tokenizer's pattern) starts as rows (word, position, end, token), one for each byte. One round of
the recursive query joins neighbouring tokens to the merge table, finds each word's leftmost pair of least rank and
contracts it; words without a pair leave the recursion. Decoding joins token rows to the vocabulary and concatenates
the pieces by an ordered aggregation. The words of a batch are found at once, and each different one is looked up once.

Null texts count as empty: no token, and the digests of nothing. Texts may be of any length: a partition handles a few
MB at a time. Words over LONG_WORD bytes are first cut where no token of the vocabulary can reach across; a round
contracts all their pairs for which that provably equals one at a time, and words of over QUERY_BYTES pass in slices, so
a query's memory is bounded. Rows may repeat and doc_id may be null; each row stands for itself. Ties of rank go to the
leftmost pair. An empty table gives an empty result. Only the columns asked for are read; one of the result's names is replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import gathered, small_batches, texts, trimmed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG_WORD = 64
BATCH_BYTES = 2_000_000
#: Words whose ids a worker remembers; from half of them on it keeps those that recur. Only speed depends on it.
CACHE_ENTRIES = 500_000
#: Words' bytes (tokens of a slice, in long ones) in one recursive query; keeps its rows, over all rounds, within DUCKDB_MEMORY. Nothing spills to a disk.
QUERY_BYTES = 200_000
DUCKDB_MEMORY = "256MB"
#: Rounds of one query over long words, which then starts anew from what it made.
LONG_ROUNDS = 6
#: Ids in one decoding query.
DECODE_TOKENS = 250_000

#: The pattern whose words are found for a batch at once; those of any other one by its own search.
OWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Kinds of code points; 0 is any other.
LETTER, NUMBER, WHITE = 1, 2, 3

#: Of the hashes of tokens and of parts of words.
FACTOR = np.uint64(0x9E3779B97F4A7C15)

ENCODE_SHORT = """
WITH RECURSIVE tokens(round, word, pos, stop, token) AS (
  SELECT 0, word, pos, stop, token FROM start_rows
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT a.word, b.pos AS pos2, b.stop AS stop2, m.rank::BIGINT << 36 | a.pos AS k
     FROM tokens a JOIN tokens b ON b.pos = a.stop JOIN merges m ON m.pair = (a.token::BIGINT << 32 | b.token)),
   best AS (SELECT word, min(k) AS k, arg_min(pos2, k) AS pos2, arg_min(stop2, k) AS stop2 FROM pairs GROUP BY word)
   SELECT round + 1, t.word, pos,
          CASE WHEN pos = (k & 68719476735) THEN b.stop2 ELSE stop END,
          CASE WHEN pos = (k & 68719476735) THEN (k >> 36)::INT ELSE token END
   FROM tokens t JOIN best b ON b.word = t.word WHERE pos <> b.pos2))
SELECT word, list(token ORDER BY pos) AS ids FROM tokens
WHERE (word, round) IN (SELECT word, max(round) FROM tokens GROUP BY word) GROUP BY word ORDER BY word
"""

#: As above, but a round contracts all pairs whose turn nothing else can change, for at most {rounds} rounds. Merges before a pair's own
#: turn form tokens with bytes of pairs that now precede it in (rank, position). No token is longer than a third of {reach}; so where all
#: those lie {reach} away, neither what they form nor what the pair itself sets off can meet. Of a rank whose token makes no pair of a
#: lesser rank (not astir), a run of overlapping pairs takes its turn as a whole: every other one. lo and hi end what a slice knows.
ENCODE_LONG = """
WITH RECURSIVE tokens(round, word, pos, stop, token) AS (
  SELECT 0, word, pos, stop, token FROM start_rows
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT a.word, a.pos, b.pos AS pos2, b.stop AS stop2, m.rank, a.pos - {reach} >= e.lo AND a.pos + {reach} <= e.hi AS inside,
            min(m.rank::BIGINT << 36 | a.pos) OVER (PARTITION BY a.word ORDER BY a.pos RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS least,
            coalesce(lag(b.pos) OVER w <> a.pos OR lag(m.rank) OVER w <> m.rank, true) AS opens
     FROM tokens a JOIN tokens b ON b.pos = a.stop JOIN merges m ON m.pair = (a.token::BIGINT << 32 | b.token) JOIN edges e ON e.word = a.word
     WHERE a.round < {rounds} WINDOW w AS (PARTITION BY a.word ORDER BY a.pos)),
   runs AS (SELECT *, rank IN (SELECT token FROM astir) AS stirs, count_if(opens) OVER (PARTITION BY word ORDER BY pos) AS run FROM pairs),
   spots AS (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) AS turn, bool_and(inside AND least >> 36 = rank) OVER (PARTITION BY word, run) AS steady FROM runs),
   taken AS MATERIALIZED (SELECT word, pos, pos2, stop2, rank FROM spots WHERE CASE WHEN stirs THEN inside AND least = (rank::BIGINT << 36 | pos) ELSE steady AND turn % 2 = 1 END)
   SELECT round + 1, t.word, t.pos, coalesce(x.stop2, t.stop), coalesce(x.rank, t.token)
   FROM tokens t LEFT JOIN taken x ON x.pos = t.pos
   WHERE t.word IN (SELECT word FROM taken) AND t.pos NOT IN (SELECT pos2 FROM taken)))
SELECT word, pos, stop, token FROM tokens
WHERE (word, round) IN (SELECT word, max(round) FROM tokens GROUP BY word) ORDER BY word, pos
"""

#: One ordered aggregation for many documents' ids; the documents' lengths cut it.
DECODE = "SELECT string_agg(piece, '' ORDER BY pos) FROM ids JOIN vocabulary USING (token)"
LENGTHS = "SELECT doc, sum(length(piece))::BIGINT AS n, count(*) AS tokens FROM ids JOIN vocabulary USING (token) GROUP BY doc"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes by one vocabulary of ranks; one for each Python worker."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.own_split = pattern == OWN_PATTERN
        self.byte_token = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, rank = [], [], []
        by_length: dict[int, list[tuple[bytes, int]]] = {}
        reach = np.zeros((256, 256), bool)
        for piece, r in ranks.items():
            by_length.setdefault(len(piece), []).append((piece, r))
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                reach[piece[i - 1], piece[i]] = True
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.reach = reach
        self.n_tokens, self.grams = max(ranks.values()) + 1, []  # for each length the tokens' hashes, ascending, and ids
        for n in range(1, max(by_length) + 1):
            listed = by_length.get(n, [])
            of = np.frombuffer(b"".join(x for x, _ in listed), np.uint8).reshape(-1, n).astype(np.uint64)
            h = of[:, 0] * FACTOR
            for k in range(1, n):
                h = (h + of[:, k]) * FACTOR
            order = np.argsort(h)
            self.grams.append((h[order], np.array([r for _, r in listed], np.int64)[order]))
        self.pairs = np.array([left, right, rank])
        keys = (self.pairs[0] << 32) | self.pairs[1]
        order = np.argsort(keys)
        self.sorted_pairs, self.sorted_ranks = keys[order], self.pairs[2][order]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        merges = pa.table({"pair": pa.array((np.array(left, np.int64) << 32) | np.array(right, np.int64)), "rank": pa.array(rank, pa.int32())})
        vocabulary = pa.table({"token": pa.array(list(ranks.values()), pa.int32()), "piece": [x.decode("latin-1") for x in ranks]})
        for name, data in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", data)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.ranks = ranks
        self.known: dict[str, bytes] = {}  # words' ids
        self.before: dict[str, bytes] = {}  # those known until there were too many; what recurs gets known again

    def _short(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, by one recursive query. Positions leave a gap between words, so pairs never cross."""
        data, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = np.arange(len(data), dtype=np.int64) + word
        self.db.register("start_rows", pa.table({"word": word, "pos": pos, "stop": pos + 1, "token": self.byte_token[data]}))
        ids = self.db.sql(ENCODE_SHORT).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("start_rows")
        flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes(), (4 * ids.offsets.to_numpy()).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _contract(self, slices: list[tuple], reach: int, rounds: int = LONG_ROUNDS) -> list[tuple]:
        """Some rounds over slices (pos, stop, token, lo, hi); the tokens left of each."""
        shift = np.cumsum([0, *[s[1][-1] - s[0][0] + 1 for s in slices]])[:-1] - [s[0][0] for s in slices]
        word = np.repeat(np.arange(len(slices), dtype=np.int32), [len(s[0]) for s in slices])
        column = lambda k: np.concatenate([s[k] for s in slices])
        self.db.register("start_rows", pa.table({"word": word, "pos": column(0) + shift[word], "stop": column(1) + shift[word], "token": column(2)}))
        self.db.register("edges", pa.table({"word": np.arange(len(slices), dtype=np.int32), "lo": [s[3] + int(d) for s, d in zip(slices, shift, strict=True)], "hi": [s[4] + int(d) for s, d in zip(slices, shift, strict=True)]}))
        found = self.db.sql(ENCODE_LONG.format(reach=reach, rounds=rounds)).to_arrow_table()
        self.db.unregister("start_rows")
        self.db.unregister("edges")
        word, pos, stop, token = (c.to_numpy() for c in found.columns)
        ends = np.searchsorted(word, np.arange(len(slices) + 1))
        return [(pos[a:b] - d, stop[a:b] - d, token[a:b].astype(np.int32)) for a, b, d in zip(ends, ends[1:], shift, strict=False)]

    def _present(self, raw: np.ndarray) -> tuple[np.ndarray, int]:
        """Which tokens occur in the bytes, and the longest one's length. A collision of hashes may only add one."""
        found, longest, h = np.zeros(self.n_tokens, bool), 1, np.zeros(len(raw) + 1, np.uint64)
        for n, (hashes, ids) in enumerate(self.grams, 1):
            if n > len(raw):
                break
            h = (h[:-1] + raw[n - 1 :]) * FACTOR
            at = np.searchsorted(hashes, h)
            hit = np.unique(at[(at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == h)]) if len(hashes) else at[:0]
            found[ids[hit]] = True
            longest = n if len(hit) else longest
        return found, longest

    def _steady(self, token: np.ndarray, astir: np.ndarray) -> bool:
        """Whether the last pair, which starts a run, is of the least rank of these tokens' pairs, and not astir."""
        pair = (token[:-1].astype(np.int64) << 32) | token[1:]
        at = np.minimum(np.searchsorted(self.sorted_pairs, pair), len(self.sorted_pairs) - 1)
        rank = np.where(self.sorted_pairs[at] == pair, self.sorted_ranks[at], np.iinfo(np.int32).max)
        return bool(rank[-1] < np.iinfo(np.int32).max and (rank >= rank[-1]).all() and rank[-1] not in astir)

    def _long(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, QUERY_BYTES at most in all, or of one word of any length, which is sliced anew each time."""
        raw = [np.frombuffer(w, np.uint8) for w in words]
        within, longest = self._present(np.concatenate(raw))
        reach = 3 * longest
        left, right, rank = self.pairs[:, within[self.pairs[2]]]
        astir = np.union1d(left[left > rank], right[right > rank])
        self.db.register("astir", pa.table({"token": astir}))
        state = [(np.arange(len(x), dtype=np.int64), np.arange(1, len(x) + 1, dtype=np.int64), self.byte_token[x]) for x in raw]
        far, idle, turn = 1 << 35, 0, 0
        while idle < 3:  # a run that two of three ways to slice cut too near its ends is whole in the third
            size = sum(len(s[0]) for s in state)
            if len(words) > 1 or len(state[0][0]) <= QUERY_BYTES:
                state = self._contract([(*s, -far, far) for s in state], reach)
                idle = 3 if sum(len(s[0]) for s in state) == size else 0
                continue
            pos, stop, token = state[0]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))  # of runs of one token
            cuts, inside = [0], [True]
            for at in range(QUERY_BYTES * (turn % 3 + 1) // 3, len(pos), QUERY_BYTES):
                k = np.searchsorted(starts, at, "right")
                first, last = int(starts[k - 1]), int(starts[k]) if k < len(starts) else len(pos)
                at -= (at - first) % 2  # within a long run of one token both sides go on alike for a round, pair by pair
                cuts.append(at)
                inside.append(min(at - first, last - at) > reach and self._steady(token[max(0, first - reach - 1) : first + 2], astir))
            cuts.append(len(pos)), inside.append(True)
            made = []
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < b:
                    lo, hi = -far if inside[i] else int(pos[a]), far if inside[i + 1] else int(stop[b - 1])
                    in_run = inside[i] and a > 0 or inside[i + 1] and b < len(pos)
                    made += self._contract([(pos[a:b], stop[a:b], token[a:b], lo, hi)], reach, 1 if in_run else LONG_ROUNDS)
            state = [tuple(np.concatenate([m[k] for m in made]) for k in range(3))]
            idle, turn = 0 if len(state[0][0]) < size else idle + 1, turn + 1
        self.db.unregister("astir")
        return [s[2].astype("<u4").tobytes() for s in state]

    @staticmethod
    def _in_queries(query: Callable[[list[bytes]], list[bytes]], words: list[bytes]) -> list[bytes]:
        out, held, size = [], [], 0
        for w in words:
            if held and size + len(w) > QUERY_BYTES:
                out += query(held)
                held, size = [], 0
            held.append(w)
            size += len(w)
        return out + (query(held) if held else [])

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        out = [b"" if (r := self.ranks.get(w)) is None else r.to_bytes(4, "little") for w in raw]  # a word that is a token stays whole
        short = [i for i, w in enumerate(raw) if w and not out[i] and len(w) <= LONG_WORD]
        for i, found in zip(short, self._in_queries(self._short, [raw[i] for i in short]), strict=True):
            out[i] = found
        pieces, owner = [], []
        for i, w in enumerate(raw):
            if out[i] or len(w) <= LONG_WORD:
                continue
            x = np.frombuffer(w, np.uint8)
            cuts = [0, *(np.flatnonzero(~self.reach[x[:-1], x[1:]]) + 1).tolist(), len(w)]
            pieces += [w[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            owner += [i] * (len(cuts) - 1)
        ids: list[bytes] = [b""] * len(pieces)
        for query, mine in ((self._short, [k for k, x in enumerate(pieces) if len(x) <= LONG_WORD]), (self._long, [k for k, x in enumerate(pieces) if len(x) > LONG_WORD])):
            for k, found in zip(mine, self._in_queries(query, [pieces[k] for k in mine]), strict=True):
                ids[k] = found
        parts: dict[int, list[bytes]] = {}
        for i, x in zip(owner, ids, strict=True):
            parts.setdefault(i, []).append(x)
        for i, found in parts.items():
            out[i] = b"".join(found)
        return out

    def _starts(self, text: str, firsts: np.ndarray) -> np.ndarray:
        """Where the pattern's words start in joined texts, which start at firsts; in code points.

        A word is a run of one kind. White space before something else leaves its last sign to it: a space joins what
        follows, other signs stand alone. An apostrophe that starts a word takes an ending of CONTRACTIONS with it.
        """
        points = np.frombuffer((text + "\0\0").encode("utf-32-le"), "<u4")
        kind = _kinds()[points[:-2]]
        opens, starts = np.zeros(len(points), bool), np.ones(len(points), bool)
        opens[firsts], opens[-2:] = True, True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:-2])
        starts |= opens
        after = np.flatnonzero(starts[1:-2] & ~opens[1:-2] & (kind[:-1] == WHITE)) + 1
        starts[after - 1] = True
        starts[after[points[after - 1] == ord(" ")]] = False
        quotes = np.flatnonzero(points == ord("'"))
        quotes = quotes[starts[quotes]]
        for ending in CONTRACTIONS if len(quotes) else ():
            here = quotes
            for k, sign in enumerate(ending, 1):
                here = here[(points[here + k] == ord(sign)) & ~opens[here + k]]
            starts[here + 1], starts[here + len(ending) + 1] = False, True
        return np.flatnonzero(starts[:-2])

    def _words(self, batch: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, and how many each text has."""
        if not self.own_split:
            found = [self.pattern.findall(text) for text in batch]
            return pa.array([w for words in found for w in words], pa.large_string()), np.array([len(x) for x in found], np.int64)
        text, size = "".join(batch), np.array([len(x) for x in batch], np.int64)
        data = text.encode()
        if not data:
            return pa.array([], pa.large_string()), size
        ends = np.cumsum(size)
        starts = self._starts(text, (ends - size)[size > 0])
        counts = np.diff(np.searchsorted(starts, ends), prepend=0)
        if len(data) > len(text):
            starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[starts]
        offsets = np.append(starts, len(data)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), counts

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of different words, remembered or made."""
        known, out, fresh = self.known, list(map(self.known.get, words)), []
        for i in [i for i, x in enumerate(out) if x is None]:
            x = out[i] = self.before.get(words[i])
            if x is None:
                fresh.append(i)
            else:
                known[words[i]] = x
        for i, x in zip(fresh, self.encode_words([words[i] for i in fresh]), strict=True):
            out[i] = x
            if len(words[i]) <= LONG_WORD:  # longer ones seldom recur
                known[words[i]] = x
        if len(known) > CACHE_ENTRIES // 2:
            self.known, self.before = {}, known
        return out

    def encode(self, batch: list[str]) -> list[bytes]:
        words, counts = self._words(batch)
        coded = words.dictionary_encode()
        ids, which = self._ids(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        n = np.array([len(x) // 4 for x in ids], np.int64)
        begins, sizes = (np.cumsum(n) - n)[which], n[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(begins - ends[:-1], sizes)
        at += np.arange(len(at))
        flat, cuts = np.frombuffer(b"".join(ids), "<u4")[at], ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, batch: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids. An id without a token is an error."""
        lengths = np.array([len(x) // 4 for x in batch], np.int64)
        token = np.frombuffer(b"".join(batch), "<u4").astype(np.int32)
        doc, data = np.repeat(np.arange(len(batch), dtype=np.int32), lengths), []
        n, tokens = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for lo in range(0, len(token), DECODE_TOKENS):
            part = slice(lo, lo + DECODE_TOKENS)
            self.db.register("ids", pa.table({"doc": doc[part], "pos": np.arange(len(token[part]), dtype=np.int32), "token": token[part]}))
            data.append((self.db.sql(DECODE).fetchall()[0][0] or "").encode("latin-1"))
            for i, size, count in self.db.sql(LENGTHS).fetchall():
                n[i] += size
                tokens[i] += count
            self.db.unregister("ids")
        if not np.array_equal(tokens, lengths):
            raise ValueError(f"{(lengths - tokens).sum()} ids have no token")
        data, ends = b"".join(data), [0, *np.cumsum(n).tolist()]
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@functools.cache
def _kinds() -> np.ndarray:
    """Every code point's kind, by the module that knows the pattern's classes."""
    points, kinds = "".join(map(chr, range(0x110000))), np.zeros(0x110000, np.uint8)
    for kind, run in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for found in regex.finditer(run, points):
            kinds[found.start() : found.end()] = kind
    return kinds


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec; workers live on from task to task, and so does what it remembers."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _run(df: DataFrame, given: str, schema: str, kernel, path: str | None, pattern: str | None) -> DataFrame:
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches, given, BATCH_BYTES):
            yield from kernel(codec(path, pattern), rows).to_batches()

    return df.mapInArrow(trimmed(run), schema)


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(ids), "<i4"))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with the column ids: the text's token ids. A column of that name is replaced."""
    df = df.drop(ids) if ids in df.columns else df
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{ids}` array<int>"
    return _run(df, text, schema, lambda c, rows: rows.append_column(ids, _lists(c.encode(texts(rows.column(text))))), path, pattern)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the column decoded: the bytes of its ids; null ids count as none."""
    df = df.drop(decoded) if decoded in df.columns else df
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{decoded}` binary"

    def kernel(c: Codec, rows: pa.Table) -> pa.Table:
        given = [np.array([] if x is None else x, "<u4").tobytes() for x in rows.column(ids).to_pylist()]
        return rows.append_column(decoded, pa.array(c.decode(given), pa.binary()))

    return _run(df, ids, schema, kernel, path, None)


def round_trip(df: DataFrame, keep: list[str] | None = None, text: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """The columns keep (doc_id, if None), n_tokens, the SHA-256 of the ids and of what they decode to, and the ids if asked for; encoded and decoded in one pass, so that ids needn't leave the worker."""
    keep = ["doc_id"] if keep is None else keep

    def kernel(c: Codec, rows: pa.Table) -> pa.Table:
        ids = c.encode(texts(rows.column("__text")))
        digest = lambda xs: [hashlib.sha256(x).hexdigest() for x in xs]
        made = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": digest(ids), "decoded_sha256": digest(c.decode(ids))}
        return pa.table({k: rows.column(k) for k in keep} | made | ({"ids": _lists(ids)} if with_ids else {}))

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    schema = f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _run(df.select(*[df[k] for k in keep], df[text].alias("__text")), "__text", schema, kernel, path, pattern)
