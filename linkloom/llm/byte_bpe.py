"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

Each Spark task cuts its texts into chunks that no piece reaches across, splits the distinct chunks into pieces, and gives
the distinct pieces to an embedded DuckDB as token-position rows (a piece that is a token is one row from the start). A
recursive query joins neighbouring tokens to the merge table and contracts, in every piece, the leftmost pair of least
rank until no pair merges. An ordered aggregation over the surviving rows gives the ids.

Decoding starts from ids alone: a document is the ids of its chunks, and each distinct run of ids is joined to the
vocabulary and aggregated in order to the bytes it stands for. What a worker has encoded and decoded it remembers in two
generations: when the younger is full the older goes, and what was asked for since has moved to the younger by then.

Cases: null and empty texts have no tokens; whole texts are encoded, very long ones in slices; repeated rows are encoded
alike; extra columns are ignored. No special tokens are recognised.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
import re
import tempfile
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import public_tokenizers
from pyspark.sql import DataFrame

from linkloom.llm.common import ship, trimmed

#: Texts are taken in blocks of about so many characters, longer ones in slices, and distinct pieces in blocks of so many bytes.
TEXT_BLOCK = 4_000_000
PIECE_BLOCK = 250_000
#: Pieces of more bytes are contracted at many places in a step, and in rounds of ROUND steps, fewer if they are very long.
LONG = 64
ROUND = 64
#: Entries of a memory's younger generation, and characters of the longest key that is remembered.
KNOWN = 400_000
KNOWN_LENGTH = 200

_PAIRS = """
    SELECT a.w, a.pos AS place, a.nxt AS gone, m.rank, m.safe, a.ord
    FROM (SELECT w, pos, (tok::BIGINT << 20) | lead(tok) OVER o AS pair, lead(pos) OVER o AS nxt, row_number() OVER o AS ord
          FROM t WINDOW o AS (PARTITION BY w ORDER BY pos)) a
    JOIN merges m USING (pair)"""

#: Short pieces: one contraction for each piece and step. A row knows its neighbour to the right (npos, ntok) and, as one
#: number, the rank of their pair, its own place and the neighbour's. Of the two tokens of a contraction the right one's row
#: stays, as it knows what follows; only rows beside a contraction look up a new rank.
_SHORT = """
    WITH RECURSIVE t(step, w, pos, tok, npos, ntok, key) AS (
        SELECT 0, s.w, s.pos, s.tok, s.npos, s.ntok, (m.rank::BIGINT << 40) | (s.pos << 20) | s.npos
        FROM seed s LEFT JOIN merges m ON m.pair = (s.tok::BIGINT << 20) | s.ntok
        UNION ALL
        SELECT c.step + 1, c.w, c.pos,
               CASE WHEN c.pos = c.gone THEN c.best ELSE c.tok END, c.next,
               CASE WHEN c.npos = c.place THEN c.best ELSE c.ntok END,
               CASE WHEN c.pair IS NULL THEN c.key ELSE (m.rank::BIGINT << 40) | (c.pos << 20) | c.next END
        FROM (SELECT t.*, b.best, b.place, b.gone, CASE WHEN t.npos = b.place THEN b.gone ELSE t.npos END AS next,
                     CASE WHEN t.pos = b.gone THEN (b.best << 20) | t.ntok WHEN t.npos = b.place THEN (t.tok::BIGINT << 20) | b.best END AS pair
              FROM t
              JOIN (SELECT w, k >> 40 AS best, (k >> 20) & 1048575 AS place, k & 1048575 AS gone
                    FROM (SELECT w, min(key) AS k FROM t GROUP BY w) WHERE k IS NOT NULL) b ON b.w = t.w
              WHERE t.pos <> b.place) c
        LEFT JOIN merges m ON m.pair = c.pair
    )
    SELECT w, pos, tok FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step)"""

#: All contractions of the least rank that cannot bring about a pair of a lesser one, else the leftmost alone.
_HITS = f"""
    SELECT w, place, gone, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY w, ord - k ORDER BY ord) AS in_run FROM (
            SELECT *, row_number() OVER (PARTITION BY w ORDER BY ord) AS k FROM (
                SELECT *, min(rank) OVER (PARTITION BY w) AS best FROM ({_PAIRS}))
            WHERE rank = best))
    WHERE CASE WHEN safe THEN in_run % 2 = 1 ELSE k = 1 END"""
_LONG = """
    WITH RECURSIVE t(step, w, pos, tok) AS (
        SELECT 0, w, pos, tok FROM seed
        UNION ALL
        SELECT c.step + 1, c.w, c.pos, CASE WHEN c.role = 1 THEN c.rank ELSE c.tok END
        FROM (
            SELECT t.step, t.w, t.pos, t.tok, max(e.rank) AS rank, coalesce(max(e.role), 0) AS role
            FROM t
            JOIN (SELECT DISTINCT w FROM (%(hits)s)) live ON live.w = t.w
            LEFT JOIN (SELECT w, unnest([place, gone]) AS pos, rank, unnest([1, 2]) AS role FROM (%(hits)s)) e ON e.w = t.w AND e.pos = t.pos
            GROUP BY t.step, t.w, t.pos, t.tok) c
        WHERE c.role <> 2 AND c.step < %(steps)s
    )
    SELECT w, pos, tok, step FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step)"""


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """The rank file's tokens; read on the driver, a bounded vocabulary that goes to the tasks with the function."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _list(column) -> list:
    """A column without nulls as a list, faster than to_pylist."""
    return (column.combine_chunks() if hasattr(column, "combine_chunks") else column).to_numpy(zero_copy_only=False).tolist()


class Memory:
    """A dictionary of two generations."""

    def __init__(self, most: int):
        self.young, self.old, self.most, self.long = {}, {}, most, []

    def turn(self) -> None:
        """Before a block: what is too long to be remembered goes, and if the younger generation is full, the older."""
        for k in self.long:
            self.young.pop(k, None)
        self.long = []
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}

    def missing(self, keys: set) -> list:
        """The keys that are unknown; the others are in the younger generation from now on."""
        rest = keys.difference(self.young)
        new = rest.difference(self.old)
        again = rest - new
        self.young.update(zip(again, map(self.old.__getitem__, again)))
        self.long += [k for k in new if len(k) > KNOWN_LENGTH]
        return list(new)


class Encoder:
    """Encodes and decodes on a DuckDB of its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, threads: int = 1, memory: str = "200MB"):
        import duckdb
        import numpy as np
        import pyarrow as pa

        self.ranks, self.split = ranks, splitter(pattern)
        self.cuts = pattern == public_tokenizers.PATTERN
        self.forget(KNOWN)
        self.fresh: dict[str, list[str]] = {}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges, unsafe = [], set()
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    merges.append((left << 20 | right, rank))
                    unsafe.update(x for x in (left, right) if x > rank)
        self.con = duckdb.connect()
        self.con.execute(f"SET threads = {threads}")
        self.con.execute(f"SET memory_limit = '{memory}'")
        self.con.execute(f"SET temp_directory = '{tempfile.gettempdir()}/linkloom-duckdb-{os.getpid()}'")
        self.con.register("m_", pa.table({"pair": pa.array([m for m, _ in merges], pa.int64()), "rank": pa.array([r for _, r in merges], pa.int32()), "safe": pa.array([r not in unsafe for _, r in merges])}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m_")
        self.con.register("v_", pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in ranks])}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM v_")
        for x in ("m_", "v_"):
            self.con.unregister(x)

    def forget(self, known: int) -> None:
        self.runs_, self.bytes_ = Memory(known), Memory(known)
        # A piece of PATTERN that stands alone is one piece again, so that chunks and pieces share a memory.
        self.pieces_ = self.runs_ if self.cuts else Memory(known)

    def turn(self) -> None:
        for memory in (self.runs_, self.pieces_, self.bytes_):
            memory.turn()

    def _run(self, sql: str, **tables):
        for name, table in tables.items():
            self.con.register(name, table)
        try:
            return self.con.sql(sql).to_arrow_table()
        finally:
            for name in tables:
                self.con.unregister(name)

    def _fixpoint(self, pieces: list[bytes], long: bool):
        import numpy as np
        import pyarrow as pa

        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        sizes = np.where(whole >= 0, 1, np.array([len(p) for p in pieces]))
        flat = np.frombuffer(b"".join(p if w < 0 else p[:1] for p, w in zip(pieces, whole.tolist())), np.uint8)
        given = np.repeat(whole, sizes)
        tok = np.where(given >= 0, given, self.byte[flat])
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = pos == np.repeat(sizes, sizes) - 1
        rows = pa.table({
            "w": np.repeat(np.arange(len(pieces), dtype=np.int32), sizes), "pos": pos, "tok": tok,
            "npos": np.where(last, -1, pos + 1), "ntok": np.where(last, -1, np.concatenate((tok[1:], [-1]))),
        })
        if not long:
            return self._run(_SHORT, seed=rows)
        done = []
        while rows.num_rows:
            steps = max(1, min(ROUND, ROUND * PIECE_BLOCK // rows.num_rows))
            out = self._run(_LONG % {"hits": _HITS, "steps": steps}, seed=rows)
            more = out.column("step").to_numpy() >= steps
            done.append(out.filter(pa.array(~more)).select(["w", "pos", "tok"]))
            rows = out.filter(pa.array(more)).select(["w", "pos", "tok"])
        return pa.concat_tables([t.cast(done[0].schema) for t in done])

    def ids_of_pieces(self, pieces: set) -> dict[str, str]:
        """A dictionary with the ids of these distinct pieces, and others, joined by spaces."""
        return self._contracted(self.pieces_.missing(pieces))

    def _contracted(self, pieces: Iterable[str]) -> dict[str, str]:
        """The same for pieces that are unknown, all of them."""
        known = self.pieces_
        wait: dict[bool, list[str]] = {False: [], True: []}
        for p in pieces:
            wait[len(p) * 4 > LONG and len(p.encode()) > LONG].append(p)
        for long, todo in wait.items():
            spelt = [p.encode() for p in todo]
            ends = list(accumulate(map(len, spelt)))
            at = 0
            while at < len(todo):
                end = max(at + 1, bisect_right(ends, (ends[at - 1] if at else 0) + PIECE_BLOCK))
                rows = self._fixpoint(spelt[at:end], long)
                got = self._run("SELECT string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS ids FROM rows GROUP BY w ORDER BY w", rows=rows)
                known.young.update(zip(todo[at:end], _list(got.column("ids"))))
                at = end
        return known.young

    def ids_of(self, chunks: set) -> dict[str, str]:
        """A dictionary with the ids of these distinct chunks, and others, joined by spaces."""
        new = self.runs_.missing(chunks)
        if new:
            alone = set(filter(_ONE, new)) if self.cuts else set()
            rest = [c for c in new if c not in alone]
            pieces = list(map(self.split, rest))
            ids = self._contracted(alone.union(self.pieces_.missing(set().union(*pieces))))
            for c, p in zip(rest, pieces):
                own = list(map(ids.__getitem__, p))
                run = self.runs_.young[c] = " ".join(own)
                if len(own) > 1:
                    self.fresh[run] = own
        return self.runs_.young

    def bytes_of(self, runs: set) -> dict[str, bytes]:
        """A dictionary with the bytes that these distinct runs of ids stand for, and others. Runs that have just been put
        together are put together from the bytes of their parts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        fresh, self.fresh = self.fresh, {}
        new, young = self.bytes_.missing(runs), self.bytes_.young
        joined = [r for r in new if r in fresh]
        parts = set().union(*map(fresh.__getitem__, joined))
        parts.update(r for r in new if r not in fresh)
        todo = self.bytes_.missing(parts)
        if todo:
            ids = pc.split_pattern(pa.array(todo, pa.large_string()), " ")
            young.update(zip(todo, self._decoded(pc.list_parent_indices(ids), pc.cast(pc.list_flatten(ids), pa.int32()), len(todo))))
        for r in joined:
            young[r] = b"".join(map(young.__getitem__, fresh[r]))
        return young

    def _decoded(self, w, tok, n: int) -> list[bytes]:
        """For rows (w, tok), in order: the bytes of each w from 0 to n - 1."""
        import numpy as np
        import pyarrow as pa

        rows = pa.table({"w": w, "pos": np.arange(len(tok)), "tok": tok})
        got = self._run("SELECT w, unhex(string_agg(hex, '' ORDER BY pos)) AS spelt, count(hex) AS known, count(*) AS n FROM rows LEFT JOIN vocabulary USING (tok) GROUP BY w", rows=rows)
        if (got.column("known").to_numpy() < got.column("n").to_numpy()).any():
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * n
        for k, spelt in zip(_list(got.column("w")), _list(got.column("spelt"))):
            out[k] = spelt
        return out

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids."""
        import pyarrow as pa

        return self._decoded(pa.array([k for k, x in enumerate(ids) for _ in x], pa.int64()), pa.array([t for x in ids for t in x], pa.int32()), len(ids))

    def chunks(self, text: str) -> list[str]:
        """A text cut before each space that something other than white space follows: there every piece of PATTERN ends."""
        if not self.cuts:
            return [text] if text else []
        return [c for c in _CUTS.split(text) if c]

    def documents(self, texts: list[str], most: int) -> Iterator[tuple[str, bytes]]:
        """For each text its ids, joined by spaces, and the bytes that these stand for.

        Where every space begins a chunk, texts of up to `most` characters are cut, and put together again, as columns: a chunk is
        looked up once, however often it occurs.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        apart = [None if self.cuts and len(t) <= most and not _RAGGED(t) else self.chunks(t) for t in texts]
        heads, tails = [], []
        for text, own in zip(texts, apart):
            if own is None:
                head, space, tail = text.partition(" ")
                own = [head] if head else []
                if space:
                    tails.append(tail)
            else:
                space = ""
            heads.append((own, bool(space)))
        lists = pc.split_pattern(pa.array(tails, pa.string()), " ")
        found = lists.flatten().dictionary_encode()
        keys = _list(pc.binary_join_element_wise("", found.dictionary, " "))
        ids_of = self.ids_of(set(keys).union(*[own for own, _ in heads]))
        distinct = list(map(ids_of.__getitem__, keys))
        bytes_of = self.bytes_of(set(distinct).union(*[map(ids_of.__getitem__, own) for own, _ in heads]))

        def joined(values: list, kind, between) -> Iterator:
            rows = pa.array(values, kind).take(found.indices)
            return iter(pc.binary_join(pa.ListArray.from_arrays(lists.offsets, rows), between).to_pylist())

        ids, spelt = joined(distinct, pa.string(), " "), joined(list(map(bytes_of.__getitem__, distinct)), pa.binary(), b"")
        for own, more in heads:
            runs = list(map(ids_of.__getitem__, own))
            decoded = list(map(bytes_of.__getitem__, runs))
            if more:
                runs.append(next(ids))
                decoded.append(next(spelt))
            yield " ".join(runs), b"".join(decoded)


#: A chunk that is one piece of PATTERN.
_ONE = re.compile(r" ?(?:[A-Za-z]+|[0-9]+)").fullmatch
_RAGGED = re.compile(r" (?=\s|\Z)").search
_CUTS = re.compile(r"(?= \S)")
_own: dict = {}


def _encoder(ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """This process's encoder; a worker keeps it from task to task."""
    if _own.get("of") != (ranks, pattern):
        _own.update(of=(ranks, pattern), encoder=Encoder(ranks, pattern))
    return _own["encoder"]


#: White space as Unicode has it; the regex library's own class also holds U+001C to U+001F.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def splitter(pattern: str = public_tokenizers.PATTERN):
    import regex

    own = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    return regex.compile(own).findall


def _slices(text: str, cuts: bool, block: int) -> Iterator[str]:
    """A text in slices of about `block` characters, cut where chunks end; whole if pieces may reach across."""
    at = 0
    while cuts and len(text) - at > block and (m := _CUTS.search(text, at + block)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def _blocks(batches, cuts: bool, most: int):
    """Rows (id, slice of the text, whether it is the last) in lists of about `most` characters."""
    block, size = [], 0
    for batch in batches:
        for key, text in zip(*(c.to_pylist() for c in batch.columns)):
            before = None
            for part in _slices(text or "", cuts, most):
                if before is not None:
                    block.append((key, before, False))
                before = part
                size += len(part)
                if size >= most and block:
                    yield block
                    block, size = [], len(part)
            block.append((key, before, True))
    if block:
        yield block


class _Document:
    """What comes of one document, slice by slice."""

    def __init__(self, with_ids: bool):
        self.n, self.ids_hash, self.bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
        self.ids, self.decoded = ([], []) if with_ids else (None, None)

    def add(self, ids: str, decoded: bytes) -> None:
        if not ids:
            return
        self.ids_hash.update((" " + ids if self.n else ids).encode())
        self.bytes_hash.update(decoded)
        self.n += ids.count(" ") + 1
        if self.ids is not None:
            self.ids += map(int, ids.split())
            self.decoded.append(decoded)

    def row(self, key) -> tuple:
        more = () if self.ids is None else (self.ids, b"".join(self.decoded))
        return key, self.n, self.ids_hash.hexdigest(), self.bytes_hash.hexdigest(), *more


def encode_rows(ranks: dict[bytes, int], pattern: str, with_ids: bool, most: int = TEXT_BLOCK, known: int = KNOWN, keep: bool = False):
    """A function for mapInArrow over (id, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + ([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if with_ids else []))
        doc = block = encoder = None
        gc.disable()  # what a block makes is millions of strings and lists of them, without a cycle
        try:
            for block in _blocks(batches, pattern == public_tokenizers.PATTERN, most):
                if encoder is None:
                    encoder = _encoder(ranks, pattern)
                    if encoder.runs_.most != known:
                        encoder.forget(known)
                encoder.turn()
                out = []
                for (key, _, last), (ids, decoded) in zip(block, encoder.documents([text for _, text, _ in block], 2 * most)):
                    doc = doc or _Document(with_ids)
                    doc.add(ids, decoded)
                    if last:
                        out.append(doc.row(key))
                        doc = None
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        finally:
            gc.enable()
        if encoder and not keep:
            encoder.forget(known)
            del block
            trimmed()

    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True, block: int = TEXT_BLOCK, known: int = KNOWN, keep: bool = True) -> DataFrame:
    """Every row's ids and the bytes they decode to: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    block, known: characters that are taken at once and entries that are remembered, which trade memory for speed. keep: a
    worker remembers from task to task; if not, it gives memory back at each task's end, for what runs after.
    """
    ship(df.sparkSession)
    schema = f"id long, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>, decoded binary' if with_ids else ''}"
    return df.select(df[id_col].cast("long"), df[text_col]).mapInArrow(encode_rows(load_ranks(ranks_path), pattern, with_ids, block, known, keep), schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """The text of every row of ids; bytes that are not UTF-8 become U+FFFD. Null ids decode to an empty text."""
    ship(df.sparkSession)
    ranks = load_ranks(ranks_path)

    def run(batches):
        import pyarrow as pa

        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(ranks)
            texts = [b.decode("utf-8", "replace") for b in encoder.decode([x or [] for x in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(df[id_col].cast("long").alias("id"), df[ids_col].cast("array<int>")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def op2(df: DataFrame) -> DataFrame:
    return encode(df, with_ids=False)
