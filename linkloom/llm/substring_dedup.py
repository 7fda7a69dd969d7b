"""Substring dedup by De Bruijn compaction over whole texts.

Windows of WINDOW words are the edges of a De Bruijn graph. They are dealt out by minimizer: of the sub-windows of
MINIMIZER words in a window, the one of least hash. Equal windows have equal minimizers and so meet in one task, and the
runs of windows that share one occurrence of a minimizer move as one row. Before that, each task resolves the windows
that repeat within a block of its own documents, so that a passage which a third of all documents share moves once for
each block.

Where equal windows meet, the occurrence in the document of least identifier is their source. Repeated windows that
follow one another in a document and in its source, word for word, are a nonbranching path; paths compact into long
spans, each with the coordinates of its source: where one edge ends and the next begins, on the same document, source and
distance between the two, a place is an inner one; what is left are the ends of paths, which are joined. Spans meet the texts in a join by
document, and a digest of the words at the source's coordinates is compared with that of the span. Should a hash have misled
any span, as may happen under a minimizer with a million windows (a window's own hash has 40 bits there), the search is made
again with other hashes of 64 bits until none is misled, so that no true source is lost to a false one.

Cases: null text has no words; texts shorter than a window lose nothing; windows of one document never count against
itself, nor do rows of the same identifier against each other; a null identifier comes after all others; repeated rows
get the same result; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import checkpointed, pack, ship, unpack

WINDOW, MINIMIZER = 13, 4
#: Bytes of text whose windows are resolved among themselves first.
BLOCK = 3_000_000
#: Bytes of text that hashes are made of at once.
PIECE = 4_000_000
#: Bytes of a window's own hash, beside the 64 bits of its minimizer's: at first, and when the search is made again.
TAG, WIDE_TAG = 5, 8
#: Searches that are made before an error is raised.
SEARCHES = 6
#: The identifier that stands for null: above all others.
NO_ID = 2**63 - 1
#: A minimizer is hot if so many documents of the sample, or more, have it; its windows are dealt out one by one.
HOT, SAMPLE = 40, 4000

ROWS = "key long, doc long, row long, start int, n int, tags binary, src long, src_row long, src_start int"


@cache
def _tables():
    import numpy as np

    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    base, inverse = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 2**64)
    return blank, np.uint64(base), np.uint64(inverse)


_powers: dict = {}


def _power_table(n: int):
    import numpy as np

    if _powers.get("n", -1) < n:
        _, base, inverse = _tables()
        for name, b in (("up", base), ("down", inverse)):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes):
    """(hash of each word, start of each word) of UTF-8 text."""
    import numpy as np

    blank, *_ = _tables()
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):  # cut at white space
            buffer = np.frombuffer(data, np.uint8, end - at, at)
            cut = np.flatnonzero(blank[buffer[-65536:]]) if end - at > 65536 else np.flatnonzero(blank[buffer])
            if len(cut):
                end = end - min(65536, end - at) + int(cut[-1]) + 1
            else:
                while end < len(data) and not blank[data[end]]:
                    end += 1
        buffer = np.frombuffer(data, np.uint8, end - at, at)
        is_blank = np.concatenate(([True], blank[buffer], [True]))
        first = np.flatnonzero(is_blank[:-1] & ~is_blank[1:])
        after = np.flatnonzero(~is_blank[:-1] & is_blank[1:])
        up, down = _power_table(max(PIECE + 65536, len(buffer)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], dtype=np.uint64)))
        hashes.append(_mix((sums[after] - sums[first]) * down[first] + (after - first).astype(np.uint64)))
        starts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def _rolled(h, n: int, factor: int):
    """A hash of each n neighbouring hashes."""
    import numpy as np

    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(factor) + h[k : k + len(out)]
    return _mix(out)


def windows(texts: list[bytes], window: int, minimizer: int, search: int = 0):
    """Of all texts: for each window, the index of its text, its start among the text's words, its hash, and the hash
    and the place of its minimizer."""
    import numpy as np

    data = b"\n".join(texts)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    h, at = word_hashes(data)
    if len(h) < window:
        return None
    text = np.searchsorted(ends, at, side="right")
    first = np.searchsorted(text, np.arange(len(texts)))
    whole = text[: len(h) - window + 1] == text[window - 1 :]
    tag = _rolled(_mix(h + np.uint64(search)) if search else h, window, 0xD6E8FEB86659FD93)
    sub = _rolled(h, minimizer, 0xA0761D6478BD642F)
    n, span = len(tag), window - minimizer + 1
    least, place = sub[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, span):
        other = sub[k : k + n]
        less = other < least
        least[less] = other[less]
        place[less] = k
    keep = np.flatnonzero(whole)
    text = text[:n][keep]
    return text, (keep - first[text]).astype(np.int64), tag[keep], least[keep], (place + np.arange(n))[keep]


def _blocks(batches):
    """Lists of (doc, row, text bytes), in order of doc."""
    block, size = [], 0
    for batch in batches:
        docs, rows = (batch.column(c).to_pylist() for c in (0, 1))
        for k in range(batch.num_rows):
            text = (batch.column(2)[k].as_py() or "").encode()
            block.append((NO_ID if docs[k] is None else docs[k], rows[k], text))
            size += len(text)
            if size >= BLOCK:
                yield sorted(block, key=lambda x: x[:2])
                block, size = [], 0
    if block:
        yield sorted(block, key=lambda x: x[:2])


def _runs(follows):
    """Starts and ends of runs; follows[k]: item k + 1 goes on from item k."""
    import numpy as np

    cuts = np.flatnonzero(~follows) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(follows) + 1]))


def _to_edges(window: int, minimizer: int, hot, search: int, width: int):
    """Over (doc, row, text): rows of windows by minimizer, and spans that the block itself resolves (tags null)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for block in _blocks(batches):
            found = windows([t for _, _, t in block], window, minimizer, search)
            if found is None or not len(found[0]):
                continue
            text, start, tag, least, place = found
            ids, rows = np.array([b[0] for b in block], np.int64), np.array([b[1] for b in block], np.int64)
            # Equal windows of the block: the first is in the least document, as texts are in that order.
            both = tag ^ _mix(least)
            order = np.argsort(both, kind="stable")
            begins = np.concatenate(([True], both[order][1:] != both[order][:-1]))
            source = np.empty(len(order), np.int64)
            source[order] = order[begins][np.cumsum(begins) - 1]
            known = ids[text[source]] < ids[text]
            # A window that its own text has had before is left to _cut, which treats equal windows of a text alike.
            again = np.zeros(len(order), bool)
            again[order[1:]] = ~begins[1:] & (text[order][1:] == text[order][:-1])
            # Spans: windows that follow one another, here and at the source.
            w = np.flatnonzero(known & ~again)
            if len(w):
                s = source[w]
                a, b = _runs((np.diff(w) == 1) & (text[w][1:] == text[w][:-1]) & (np.diff(s) == 1) & (text[s][1:] == text[s][:-1]))
                x, y = w[a], s[a]
                yield _rows(_mix(both[x]).view(np.int64), ids[text[x]], rows[text[x]], start[x], b - a, None, ids[text[y]], rows[text[y]], start[y])
            # The others, by occurrence of a minimizer; windows of hot ones each by itself.
            w = np.flatnonzero(~known & ~again)
            if not len(w):
                continue
            is_hot = np.isin(least[w], hot) if len(hot) else np.zeros(len(w), bool)
            a, b = _runs((np.diff(w) == 1) & (text[w][1:] == text[w][:-1]) & (np.diff(place[w]) == 0) & ~is_hot[1:])
            x = w[a]
            key = np.where(is_hot[a], _mix(both[x]), least[x]).view(np.int64)
            tags = np.ascontiguousarray(tag[w]).view(np.uint8).reshape(-1, 8)[:, :width]
            tags = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.concatenate((a, b[-1:])) * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(tags).tobytes())])
            yield _rows(key, ids[text[x]], rows[text[x]], start[x], b - a, tags, None, None, None)

    return run


def _rows(key, doc, row, start, n, tags, src, src_row, src_start):
    import numpy as np
    import pyarrow as pa

    def col(x, kind):
        return pa.nulls(len(doc), kind) if x is None else x if isinstance(x, pa.Array) else pa.array(np.asarray(x), kind, safe=False)

    long, int_ = pa.int64(), pa.int32()
    return pa.RecordBatch.from_arrays([col(x, t) for x, t in ((key, long), (doc, long), (row, long), (start, int_), (n, int_), (tags, pa.binary()), (src, long), (src_row, long), (src_start, int_))], ["key", "doc", "row", "start", "n", "tags", "src", "src_row", "src_start"])


def _to_spans(width: int):
    return lambda batches: _spans(batches, width)


def _spans(batches, width: int):
    """Over edge rows sorted by key, document and start: spans (doc, row, start, n, src, src_row, src_start).

    What is held from one batch to the next is the first occurrence of each window under the last key.
    """
    import numpy as np
    import pyarrow as pa

    names = ["doc", "row", "start", "n", "src", "src_row", "src_start"]
    held = None  # (key, tags, docs, rows, starts)
    for batch in batches:
        table = pa.Table.from_batches([batch])
        done = table.filter(table["tags"].is_null()).select(names)
        yield from (b for b in done.to_batches() if b.num_rows)
        table = table.filter(table["tags"].is_valid()).combine_chunks()
        if not table.num_rows:
            continue
        key, doc, row, start, n = (table[c].to_numpy().astype(np.int64) for c in ("key", "doc", "row", "start", "n"))
        flat = b"".join(table["tags"].to_pylist())
        tag = np.zeros((len(flat) // width, 8), np.uint8)
        tag[:, :width] = np.frombuffer(flat, np.uint8).reshape(-1, width)
        tag = tag.view(np.uint64).ravel()
        owner = np.repeat(np.arange(len(n)), n)
        begun = np.cumsum(n) - n
        w_key, w_doc, w_row, w_start = key[owner], doc[owner], row[owner], start[owner] + np.arange(len(owner)) - begun[owner]
        own = len(w_key)
        if held is not None and held[0] == key[0]:
            w_key, tag, w_doc, w_row, w_start = (np.concatenate(x) for x in ((np.full(len(held[1]), held[0]), w_key), (held[1], tag), (held[2], w_doc), (held[3], w_row), (held[4], w_start)))
        shift = len(w_key) - own
        both = _mix(w_key.view(np.uint64)) ^ _mix(tag)
        order = np.argsort(both, kind="stable")
        begins = np.concatenate(([True], both[order][1:] != both[order][:-1]))
        source = np.empty(len(order), np.int64)
        source[order] = order[begins][np.cumsum(begins) - 1]
        last = key[-1]
        firsts = np.sort(order[begins])
        firsts = firsts[w_key[firsts] == last]
        held = (last, tag[firsts], w_doc[firsts], w_row[firsts], w_start[firsts])
        w = np.flatnonzero(w_doc[source] < w_doc)
        w = w[w >= shift]
        if not len(w):
            continue
        s = source[w]
        a, b = _runs((np.diff(w) == 1) & (owner[w[1:] - shift] == owner[w[:-1] - shift]) & (w_doc[s][1:] == w_doc[s][:-1]) & (w_row[s][1:] == w_row[s][:-1]) & (np.diff(w_start[s]) == 1))
        x, y = w[a], s[a]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in ((w_doc[x], np.int64), (w_row[x], np.int64), (w_start[x], np.int32), (b - a, np.int32), (w_doc[y], np.int64), (w_row[y], np.int64), (w_start[y], np.int32))], names)


SPANS = "doc long, row long, start int, n int, src long, src_row long, src_start int"


def _hot_minimizers(rows: DataFrame, window: int, minimizer: int) -> list[int]:
    """Minimizers that many documents of a bounded sample share; it moves work, never results. At most SAMPLE / HOT times
    the number of a document's minimizers, on average."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for block in _blocks(batches):
            found = windows([t for _, _, t in block], window, minimizer)
            if found is not None:
                pairs = np.unique(np.stack((found[0].astype(np.uint64), found[3])), axis=1)
                keys, counts = np.unique(pairs[1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "n": counts.astype(np.int64)})

    share = min(1.0, SAMPLE / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64("doc", "row"), F.lit(1 << 20)) < share * (1 << 20))
    found = drawn.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).select("key").collect()
    return sorted(r["key"] for r in found)


def repeated_spans(rows: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER, search: int = 0) -> DataFrame:
    """Over (doc, row, text): compacted spans of n words, each with its source in a document of lesser identifier."""
    import numpy as np

    ship(rows.sparkSession)
    hot = np.array(_hot_minimizers(rows, window, minimizer), np.int64).view(np.uint64)
    width = WIDE_TAG if search else TAG
    edges = rows.mapInArrow(_to_edges(window, minimizer, hot, search, width), ROWS)
    met = edges.repartition("key").sortWithinPartitions("key", "doc", "row", "start").mapInArrow(_to_spans(width), SPANS)
    return _compacted(met, window)


def _compacted(met: DataFrame, window: int) -> DataFrame:
    """Runs of repeated windows as paths. A run is an edge from the place of its first window to the place after its last;
    two edges of one document and one source that are as far apart in both are on a path where one ends and the other begins.
    A place has one edge at most on either side, as every window has one source, so that no path branches: places with both
    are inner ones and go, and each place that an edge only leaves is joined with the next that one only enters."""
    on = ["doc", "row", "src", "src_row", "diagonal"]
    edges = met.select("*", (F.col("src_start") - F.col("start")).alias("diagonal"))
    sides = edges.select(*on, F.explode(F.array(F.struct(F.col("start").alias("place"), F.lit(1).alias("out")), F.struct((F.col("start") + F.col("n")).alias("place"), F.lit(-1).alias("out")))).alias("x")).select(*on, "x.*")
    outer = sides.groupBy(*on, "place").agg(F.sum("out").alias("out")).where("out <> 0")
    nth = F.row_number().over(Window.partitionBy(*on, "out").orderBy("place"))
    outer = outer.repartition(*on).withColumn("nth", nth)
    heads = outer.where("out > 0").select(*on, "nth", F.col("place").alias("start"))
    tails = outer.where("out < 0").select(*on, "nth", F.col("place").alias("end"))
    whole = heads.join(tails, [*on, "nth"])
    return whole.select("doc", "row", "start", (F.col("end") - F.col("start") + window - 1).cast("int").alias("n"), "src", "src_row", (F.col("start") + F.col("diagonal")).cast("int").alias("src_start"))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _everywhere(text: bytes, cuts: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """The spans of words that the cuts' windows cover wherever in the text they occur."""
    import numpy as np

    if not cuts:
        return []
    tag = _rolled(word_hashes(text)[0], window, 0xD6E8FEB86659FD93)
    marked = np.zeros(len(tag), bool)
    for a, b in cuts:
        marked[a : b - window + 1] = True
    starts = np.flatnonzero(np.isin(tag, tag[marked]))
    a, b = _runs(np.diff(starts) <= window)
    return list(zip(starts[a].tolist(), (starts[b - 1] + window).tolist()))


def _cut(with_text: bool, window: int):
    """Over rows sorted by doc, row, kind (0 text, 1 span to remove, 2 span that is a source): a row for each text and,
    for each span of either kind, its digest."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("src", pa.int64()), ("src_row", pa.int64()), ("src_start", pa.int32()), ("digest", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])
        out: list[tuple] = []
        name, text_of, words, copies, cuts = None, b"", [], 0, []

        def close():
            if name is None:
                return
            kept, at, removed = [], 0, 0
            for a, b in sorted(_everywhere(text_of, cuts, window)):
                kept += words[at : max(at, a)]
                removed += max(0, b - max(at, a))
                at = max(at, b)
            left = b" ".join(kept + words[at:])
            out.extend([(0, *name, None, None, None, None, None, None, len(words), removed, left.decode() if with_text else None, hashlib.sha256(left).hexdigest())] * copies)

        def ready():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(batch.num_columns - 1)]
            for k, (kind, doc, row, start, n, src, src_row, src_start) in enumerate(zip(*columns)):
                if (doc, row) != name:
                    close()
                    name, text_of, words, copies, cuts = (doc, row), b"", [], 0, []
                if kind == 0:
                    if not copies:
                        text_of = unpack(batch.column(8)[k].as_py())
                        words = text_of.split()
                    copies += 1
                else:
                    if kind == 1:
                        cuts.append((start, start + n))
                    out.append((kind, doc, row, start, n, src, src_row, src_start, _digest(words[start : start + n]), None, None, None, None))
                if len(out) >= 20_000:
                    yield ready()
        close()
        if out:
            yield ready()

    return run


_CUT = "kind int, doc long, row long, start int, n int, src long, src_row long, src_start int, digest binary, n_words long, n_removed long, kept string, kept_sha256 string"


def _cut_texts(rows: DataFrame, spans: DataFrame, sources: DataFrame, window: int, with_text: bool) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    texts = rows.select(F.coalesce("doc", F.lit(NO_ID)).alias("doc"), "row", "text").mapInArrow(pack, "doc long, row long, packed binary")
    texts = texts.select(F.lit(0).alias("kind"), "doc", "row", none("int").alias("start"), none("int").alias("n"), none("long").alias("src"), none("long").alias("src_row"), none("int").alias("src_start"), "packed")
    remove = spans.select(F.lit(1), "doc", "row", "start", "n", "src", "src_row", "src_start", none("binary"))
    needed = sources.select(F.lit(2), "src", "src_row", "src_start", "n", none("long"), none("long"), none("int"), none("binary"))
    dealt = texts.unionAll(remove).unionAll(needed).repartition("doc", "row").sortWithinPartitions("doc", "row", "kind")
    return dealt.mapInArrow(_cut(with_text, window), _CUT)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimizer: int = MINIMIZER, with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every row of df and, if asked for, the words that stay."""
    ship(df.sparkSession)
    text = F.col(f"`{text_col}`")
    doc = F.col(f"`{id_col}`").cast("long").alias("doc")
    # Rows are told apart by their identifier and, only where identifiers repeat, a hash of their text.
    unique = df.groupBy(doc).count().where("count > 1").isEmpty()
    rows = df.select(doc, (F.lit(0).cast("long") if unique else F.xxhash64(text)).alias("row"), text.alias("text"))
    once = rows if unique else rows.dropDuplicates(["doc", "row"])
    for search in range(SEARCHES):
        spans = checkpointed(repeated_spans(once, window, minimizer, search))
        cut = checkpointed(_cut_texts(rows, spans, spans.select("src", "src_row", "src_start", "n").distinct(), window, with_text))
        source = cut.where("kind = 2").select(F.col("doc").alias("src"), F.col("row").alias("src_row"), F.col("start").alias("src_start"), "n", F.col("digest").alias("there"))
        misled = cut.where("kind = 1").join(source, ["src", "src_row", "src_start", "n"], "left").where(~F.col("digest").eqNullSafe(F.col("there")))
        if misled.isEmpty():
            break
    else:
        raise RuntimeError(f"{SEARCHES} searches were misled by equal hashes")
    result = cut.where("kind = 0")
    return result.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else []))


def op4(df: DataFrame) -> DataFrame:
    return substring_dedup(df)


OP4_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS p,
             unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: array_to_string(ws[i : i + {WINDOW - 1}], ' '))) AS gram
      FROM w WHERE len(ws) >= {WINDOW}),
b AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY gram) AS first FROM g) WHERE first < doc_id),
r AS (SELECT doc_id, list(DISTINCT q) AS cut FROM (SELECT doc_id, unnest(range(p, p + {WINDOW})) AS q FROM b) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN cut IS NULL THEN array_to_string(ws, ' ')
                   ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(cut, i)), lambda i: ws[i]), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
