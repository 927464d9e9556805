"""Operator 10: byte-level BPE by recursive DuckDB queries inside each partition.

A text is split by the pattern; each match is encoded on its own. Matches that a task (or an earlier one of
the same Python worker) hasn't met are gathered and encoded together by one recursive query: rows
``(word, position, token)`` join the merge table on a token and its right neighbour, every word's leftmost
pair of least rank is contracted, and a word without a pair leaves the recursion. Decoding joins
the ids to the byte strings and aggregates them in order. Results are kept by match, and by stretch between spaces, in a cache of
bounded bytes; a partition needs memory for a block of texts, a chunk of words and that cache only.

Words longer than ``LONG`` bytes would pile up a copy of their rows for each merge. They go through a
second recursive query, keyed by position, which holds each position once and touches only the neighbours
of a merge.

Edge cases: null texts are empty texts, with no tokens; every byte is a token, so nothing is unknown; special tokens'
strings are ordinary text; repeated rows are encoded each; no rows give no rows.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._common import sliced, trimmed

#: Words and bytes of a recursive query; bytes above which a word is long; bytes of a worker's cache, about.
CHUNK_WORDS, CHUNK_BYTES, LONG, CACHE = 50_000, 800_000, 256, 400_000_000
#: Characters of a match or piece that the cache keeps at most; of a line that is cut at its spaces.
KEPT, LONG_LINE = 128, 100_000
#: Fixed value: the pattern whose matches never hold white space behind another character. Texts are cut there before
#: it is applied; with any other pattern each text is matched whole.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ENCODE = """
WITH RECURSIVE state(step, w, g, e, tok, nxt) AS (
  SELECT 0, w, g, e, tok, nxt FROM words
  UNION ALL
  SELECT s.step + 1, s.w, s.g,
         CASE WHEN s.g = b.g THEN b.far ELSE s.e END,
         CASE WHEN s.g = b.g THEN b.new ELSE s.tok END,
         CASE WHEN s.g = b.g THEN b.after WHEN s.e = b.g THEN b.new ELSE s.nxt END
  FROM state s JOIN (
    SELECT x.w, y.g, (x.best >> 30)::INTEGER AS new, y.e, z.e AS far, z.nxt AS after
    FROM (SELECT w, min((m.new::BIGINT << 30) | g) AS best FROM state JOIN merges m ON m.l = tok AND m.r = nxt GROUP BY w) x
    JOIN state y ON y.g = (x.best & 1073741823)::INTEGER
    JOIN state z ON z.g = y.e
  ) b ON b.w = s.w
  WHERE s.g <> b.e
)
SELECT string_agg(tok, ',' ORDER BY g), string_agg(hex, '' ORDER BY g)
FROM state JOIN (SELECT w, max(step) AS step FROM state GROUP BY w) last USING (w, step) JOIN vocab ON id = tok
GROUP BY w ORDER BY w
"""

#: One word; a position's row is replaced where a merge touches it. Dead positions have token -1.
ENCODE_LONG = """
WITH RECURSIVE state(g, e, prior, tok, nxt, best) USING KEY (g) AS (
  SELECT g::BIGINT, e::BIGINT, g::BIGINT - 1, tok::BIGINT, nxt::BIGINT, (m.new::BIGINT << 30) | g
  FROM words LEFT JOIN merges m ON m.l = tok AND m.r = nxt
  UNION
  SELECT t.g, t.e, t.prior, t.tok, t.nxt, (m.new::BIGINT << 30) | t.g
  FROM (
    SELECT r.g,
           CASE WHEN r.g = y.g THEN z.e ELSE r.e END AS e,
           CASE WHEN r.g = z.e THEN y.g ELSE r.prior END AS prior,
           CASE WHEN r.g = y.g THEN x.best >> 30 WHEN r.g = z.g THEN -1 ELSE r.tok END AS tok,
           CASE WHEN r.g = y.g THEN z.nxt WHEN r.g = y.prior THEN x.best >> 30 WHEN r.g = z.g THEN -1 ELSE r.nxt END AS nxt
    FROM (SELECT min(best) AS best FROM recurring.state HAVING min(best) IS NOT NULL) x
    JOIN recurring.state y ON y.g = x.best & 1073741823
    JOIN recurring.state z ON z.g = y.e
    JOIN recurring.state r ON r.g IN (y.prior, y.g, z.g, z.e)
  ) t LEFT JOIN merges m ON m.l = t.tok AND m.r = t.nxt
)
SELECT string_agg(tok, ',' ORDER BY g), string_agg(hex, '' ORDER BY g) FROM state JOIN vocab ON id = tok
"""

DECODE = """
SELECT string_agg(v.hex, '' ORDER BY i.at)
FROM ids i JOIN vocab v ON v.id = i.id GROUP BY i.w ORDER BY i.w
"""


class Codec:
    """Encodes and decodes words with the ranks of a tiktoken file, in an in-memory DuckDB of one thread."""

    def __init__(self, ranks_file: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(ranks_file, "rb") as lines:
            rank = {base64.b64decode(token): int(n) for token, n in (line.split() for line in lines if line.strip())}
        self.split = regex.compile(pattern).findall
        self.byte = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(rank[t[:k]], rank[t[k:]], n) for t, n in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        self._put("t", l=np.array([p[0] for p in pairs], np.int32), r=np.array([p[1] for p in pairs], np.int32), new=np.array([p[2] for p in pairs], np.int32))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM t")
        self._put("t", id=np.array([*rank.values()], np.int32), hex=[t.hex() for t in rank])
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM t")
        # Matches never cross a border between other characters and white space where this is the pattern.
        self.known_cuts = pattern == WORD_PATTERN
        self.pieces = regex.compile(r"\s*\S+|\s+").findall
        self.cache = CACHE
        self.clear()

    def close(self) -> None:
        """Free what the codec holds; the process makes another one when it needs it."""
        self.clear()
        self.db.close()
        for key in [k for k, v in _CODECS.items() if v is self]:
            del _CODECS[key]

    def clear(self) -> None:
        """Forget all that was encoded before."""
        # Numbers of matches and of pieces of texts, those with a space ahead and those without, and what the numbers stand for.
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self.ids: list[str] = []
        self.back: list[bytes] = []
        self.old: tuple[dict[str, int], dict[str, int], list[str], list[bytes]] = ({}, {}, [], [])
        self.held = 0

    def _put(self, name: str, **columns) -> None:
        self.db.register(name, pa.table(columns))

    def _rows(self, words: list[bytes]) -> None:
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        tok, n = self.byte[data], len(data)
        nxt = np.append(tok[1:], np.int32(-1))
        nxt[np.cumsum(size) - 1] = -1
        self._put("words", w=np.repeat(np.arange(len(words), dtype=np.int32), size), g=np.arange(n, dtype=np.int32), e=np.arange(1, n + 1, dtype=np.int32), tok=tok, nxt=nxt)

    def encode(self, words: list[bytes]) -> list[tuple[str, str]]:
        """Of each (non-empty) word the ids joined by commas, and the bytes that they decode to, in hexadecimal."""
        out: list = [None] * len(words)
        chunk: list[int] = []
        held = 0
        for k, w in enumerate([*words, None]):
            if w is None or held + len(w) > CHUNK_BYTES or len(chunk) >= CHUNK_WORDS:
                if chunk:
                    self._rows([words[i] for i in chunk])
                    for i, row in zip(chunk, self.db.execute(ENCODE).fetchall(), strict=True):
                        out[i] = row
                chunk, held = [], 0
            if w is None:
                break
            if len(w) > LONG:
                self._rows([w])
                out[k] = self.db.execute(ENCODE_LONG).fetchall()[0]
            else:
                # A word's rows are copied once for each merge.
                chunk.append(k)
                held += max(len(w), len(w) * len(w) // 16)
        return out

    def decode(self, ids: list[list[int] | np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        size = np.array([len(x) for x in ids], dtype=np.int64)
        return self._decode(np.concatenate([np.asarray(x, dtype=np.int32) for x in ids if len(x)]) if size.any() else np.zeros(0, np.int32), size)

    def _decode(self, flat: np.ndarray, size: np.ndarray) -> list[bytes]:
        if not len(flat):
            return [b""] * len(size)
        self._put("ids", w=np.repeat(np.arange(len(size)), size), at=np.arange(len(flat)), id=flat)
        found = iter(self.db.execute(DECODE).fetchall())
        return [bytes.fromhex(next(found)[0]) if n else b"" for n in size]

    def _of_old(self, names: dict[str, int], old: dict[str, int], wanted: set[str]) -> list[str]:
        """Take what the generation before knows; the rest is returned."""
        fresh = []
        for p in wanted:
            k = old.get(p)
            if k is None:
                fresh.append(p)
            else:
                names[p] = len(self.ids)
                self.ids.append(self.old[2][k])
                self.back.append(self.old[3][k])
        return fresh

    def _file(self, spaced: set[str], bare: set[str]) -> None:
        """Number pieces of texts, those with a space ahead and those without, and the matches that they hold."""
        pieces = [(p, True) for p in self._of_old(self.spaced, self.old[0], spaced)] + [(p, False) for p in self._of_old(self.bare, self.old[1], bare)]
        alone, parts, more = ([], []), [], (set(), set())
        for p, ahead in pieces:
            if p.isalpha() and self.known_cuts:
                alone[not ahead].append(p)
                continue
            matches = self.split(" " + p if ahead else p)
            keys = [(True, m[1:]) if m[0] == " " else (False, m) for m in matches]
            parts.append((p, ahead, keys))
            for space, m in keys:
                if m not in (self.spaced if space else self.bare):
                    more[not space].add(m)
        for names, known, found, ahead in ((self.spaced, self.old[0], 0, " "), (self.bare, self.old[1], 1, "")):
            words = list({*self._of_old(names, known, more[found]), *alone[found]})
            raw = [(ahead + w).encode() for w in words]
            most = min(CHUNK_WORDS, max(1000, self.cache // 5000))  # a word in the query takes some kilobytes
            for at in range(0, len(raw), most):
                done = self.encode(raw[at : at + most])
                names.update(zip(words[at : at + most], range(len(self.ids), len(self.ids) + len(done)), strict=True))
                self.ids += [ids for ids, _ in done]
                self.back += [bytes.fromhex(h) for _, h in done]
        for p, ahead, keys in parts:
            if len(keys) > 1:
                at = [(self.spaced if space else self.bare)[m] for space, m in keys]
                (self.spaced if ahead else self.bare)[p] = len(self.ids)
                self.ids.append(",".join([self.ids[k] for k in at]))
                self.back.append(b"".join([self.back[k] for k in at]))
        self.held = 330 * (len(self.spaced) + len(self.bare))

    def _lines(self, text: str) -> list[list[str]] | None:
        """The pieces of each line, the first one bare, the others with a space ahead; None where white space stands otherwise."""
        if not self.known_cuts or not text or "  " in text:
            return None
        lines = text.split("\n")
        if any([not x or len(x) > LONG_LINE or x[0].isspace() or x[-1].isspace() for x in lines]):
            return None
        cut = [x.split(" ") for x in lines]
        return None if max([max(map(len, x)) for x in cut]) > KEPT else cut

    def _numbers(self, lines: list[list[str]], spaced: set[str], bare: set[str]) -> list[int] | None:
        """The pieces' numbers, with those of the line feeds between lines; or None, and what lacks a number is put down."""
        out, whole = [], True
        of_bare, of_spaced, feed = self.bare.get, self.spaced.get, self.bare.get("\n")
        if feed is None:
            bare.add("\n")
        for k, line in enumerate(lines):
            if k:
                out.append(feed)
                whole &= feed is not None
            first = of_bare(line[0])
            if first is None:
                bare.add(line[0])
                whole = False
            out.append(first)
            found = list(map(of_spaced, line[1:]))
            if None in found:
                whole = False
                spaced.update([p for p, x in zip(line[1:], found, strict=True) if x is None])
            out += found
        return out if whole else None

    def run(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids joined by commas, and the decoded bytes."""
        cut = [self._lines(t) for t in texts]
        spaced, bare = set(), set()
        numbers = [c and self._numbers(c, spaced, bare) for c in cut]
        self._file(spaced, bare)
        numbers = [n or c and self._numbers(c, spaced, bare) for n, c in zip(numbers, cut, strict=True)]
        out = [self._joined(n) if n else self._odd(t) if t else ("", b"") for n, t in zip(numbers, texts, strict=True)]
        if self.held > self.cache // 2:
            self._turn()
        return out

    def _turn(self) -> None:
        """Begin a generation of the cache; the last one is kept until the next."""
        self.old = (self.spaced, self.bare, self.ids, self.back)
        self.spaced, self.bare, self.ids, self.back, self.held = {}, {}, [], [], 0

    def _joined(self, numbers: list[int]) -> tuple[str, bytes]:
        return ",".join(map(self.ids.__getitem__, numbers)), b"".join(map(self.back.__getitem__, numbers))

    def _odd(self, text: str) -> tuple[str, bytes]:
        """Ids and bytes of a text with white space of any kind, in stretches of bounded size."""
        ids, back = [], []
        held, size = [], 0
        for p in [*(self.pieces(text) if self.known_cuts else [text]), None]:
            if held and (p is None or size > CHUNK_BYTES):
                matches = [self.split(x) for x in held]
                words = list({m for ms in matches for m in ms if len(m) > KEPT or m not in self.bare})
                of = {w: (i, bytes.fromhex(h)) for w, (i, h) in zip(words, self.encode([w.encode() for w in words]), strict=True)}
                found = [of[m] if m in of else (self.ids[self.bare[m]], self.back[self.bare[m]]) for ms in matches for m in ms]
                ids.append(",".join([x for x, _ in found]))
                back.append(b"".join([y for _, y in found]))
                for w, (i, b) in of.items():
                    if len(w) <= KEPT:
                        self.bare[w] = len(self.ids)
                        self.ids.append(i)
                        self.back.append(b)
                self.held = 330 * (len(self.spaced) + len(self.bare))
                held, size = [], 0
            if p is not None:
                held.append(p)
                size += len(p)
        return ",".join(ids), b"".join(back)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_file: str, pattern: str) -> Codec:
    """The codec of this Python process, made once."""
    if (ranks_file, pattern) not in _CODECS:
        _CODECS[ranks_file, pattern] = Codec(ranks_file, pattern)
    return _CODECS[ranks_file, pattern]


#: Bytes of texts that are encoded together, but for longer texts.
BLOCK_BYTES = 6_000_000


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str, ids: bool = True, digests: bool = False, cache: int = CACHE, lasting: bool = True) -> DataFrame:
    """The columns of ``docs`` except ``text``, ``n_tokens``, and, as asked for, ``ids`` (array) and digests of the ids and
    of the text decoded from them. Clashing columns of the input give way to the new ones.

    ``cache`` bounds the bytes that a worker keeps of what it encoded; unless ``lasting``, it keeps nothing between tasks.
    Texts are taken in blocks of a sixtieth of that, 6 MB at most; a longer one takes memory of some ten times its own bytes."""
    new = ["n_tokens", *(["ids"] if ids else []), *(["ids_sha256", "decoded_sha256"] if digests else [])]
    keep = [c for c in docs.columns if c not in {"text", *new}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        c.cache = cache
        gc.disable()  # the cache holds no cycles, and to look for them again and again takes long
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in sliced(batches, len(keep), min(BLOCK_BYTES, cache // 60)):
            done = c.run([t or "" for t in batch.column(len(keep)).to_pylist()])
            columns = [pa.array([x.count(",") + 1 if x else 0 for x, _ in done], pa.int64())]
            if ids:
                columns.append(_id_lists([x for x, _ in done]))
            if digests:
                columns += [pa.array([sha(x.encode()) for x, _ in done]), pa.array([sha(y) for _, y in done])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *new])
        gc.enable()
        if not lasting:
            c.close()

    kinds = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), *(f"{n} {kinds[n]}" for n in new)])
    return docs.select(*keep, F.col("text").cast("string")).mapInArrow(trimmed(run), schema)


def _id_lists(joined: list[str]) -> pa.Array:
    """Ids joined by commas as lists of numbers."""
    flat = ",".join([x for x in joined if x])
    numbers = np.array(flat.split(","), dtype=np.int32) if flat else np.zeros(0, np.int32)
    ends = np.cumsum([x.count(",") + 1 if x else 0 for x in joined])
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(numbers))


def decode_documents(tokens: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """``tokens`` with a column ``text``, decoded from ``ids`` (null ids: no tokens; bytes that aren't UTF-8 become U+FFFD)."""
    keep = [c for c in tokens.columns if c != "text"]
    at = keep.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                back = c.decode([x.as_py() or [] for x in part.column(at)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([b.decode(errors="replace") for b in back])], names=[*keep, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*keep).schema), "text string"])
    return tokens.select(*keep).mapInArrow(trimmed(run), schema)
