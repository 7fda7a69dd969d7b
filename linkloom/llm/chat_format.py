"""Chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document). A visitor flattens them, in order: text is escaped
(a run of adjacent texts as one), every other part becomes a placeholder that names its kind and its number in the turn, with the reference and the count
of tokens that it will expand to recorded beside it. The template marks turns; escaping puts a backslash into every
control string inside a text, so that only the template's own marks are left and the text can be read back exactly.

A turn is formatted where it lies, in parallel. A conversation's text is its turns' texts in order; it is read back by a
stream over turns sorted by conversation, which holds a digest and never a conversation, however long.

Cases: null parts, null text and null role are empty; a null conversation is one of its own, a null turn comes first; rows of equal
turn are ordered by role and text; repeated rows are turns of their own; extra columns are ignored; an empty table gives
no conversation but those the caller adds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import ship

#: The strings that mark turns in common chat templates, and this template's own.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Tokens that a part expands to, for each unit that it names (tiles of an image, seconds of sound, pages).
TOKENS = {"image": 256, "audio": 25, "document": 800}
#: The role whose text is learned.
LEARNED = ("assistant",)

PARTS = "array<struct<kind:string,text:string,ref:string,units:long>>"
FORMATTED = "conv long, turn long, formatted string, loss_start long, loss_end long, n_tokens_expanded long, attachments array<struct<placeholder:string,kind:string,ref:string,tokens:long>>"

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_READ = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flatten:
    """Visits the parts of one turn. Adjacent texts are escaped as one, as control strings may be split over them."""

    def __init__(self, tokens: dict[str, int]):
        self.tokens, self.out, self.texts, self.attachments = tokens, [], [], []

    def flush(self) -> None:
        self.out.append(escape("".join(self.texts)))
        self.texts.clear()

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown kind of part: {kind!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def _attach(self, part: dict, kind: str) -> None:
        self.flush()
        placeholder = f"<|{kind}:{len(self.attachments)}|>"
        self.out.append(placeholder)
        self.attachments.append({"placeholder": placeholder, "kind": kind, "ref": part.get("ref"), "tokens": self.tokens[kind] * max(1, part.get("units") or 1)})

    def visit_image(self, part: dict) -> None:
        self._attach(part, "image")

    def visit_audio(self, part: dict) -> None:
        self._attach(part, "audio")

    def visit_document(self, part: dict) -> None:
        self._attach(part, "document")


def format_turn(role: str | None, parts: list[dict], tokens: dict[str, int] = TOKENS, learned: tuple = LEARNED) -> tuple[str, int, int, list[dict]]:
    """The turn's text, where its loss mask starts and ends (equal: none), its attachments."""
    visitor = Flatten(tokens)
    for part in parts:
        visitor.visit(part)
    visitor.flush()
    body = "".join(visitor.out)
    head = TURN + escape(role or "") + TEXT
    return head + body + END, len(head), len(head) + (len(body) if (role or "") in learned else 0), visitor.attachments


def _format(tokens, learned):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = None
        for batch in batches:
            convs, turns, roles, contents = (c.to_pylist() for c in batch.columns)
            rows = []
            for conv, turn, role, parts in zip(convs, turns, roles, contents):
                text, start, end, attached = format_turn(role, parts or [], tokens, learned)
                rows.append({"conv": conv, "turn": turn, "formatted": text, "loss_start": start, "loss_end": end, "n_tokens_expanded": sum(a["tokens"] for a in attached), "attachments": attached})
            schema = schema or pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("n_tokens_expanded", pa.int64()), ("attachments", pa.list_(pa.struct([("placeholder", pa.string()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str | None = "text", parts_col: str | None = None, tokens: dict[str, int] = TOKENS, learned: tuple = LEARNED) -> DataFrame:
    """A row for each turn: conv, turn, its formatted text, its loss span, expanded tokens, attachments."""
    ship(df.sparkSession)
    parts = F.col(parts_col).cast(PARTS) if parts_col else F.array(F.struct(F.lit("text").alias("kind"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))
    return df.select(F.col(conv_col).cast("long"), F.col(turn_col).cast("long"), F.col(role_col), parts).mapInArrow(_format(tokens, learned), FORMATTED)


def in_order(turns: DataFrame) -> DataFrame:
    """Formatted turns dealt by conversation and sorted; ties by their text, which begins with the role."""
    return turns.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "formatted")


def conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation, its whole text in one string: for conversations that fit into memory."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "formatted", "n_tokens_expanded")))
    return turns.groupBy("conv").agg(ordered.alias("t")).select("conv", F.array_join(F.transform("t", lambda x: x["formatted"]), "").alias("formatted"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens_expanded"]).alias("n_tokens_expanded"))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; placeholders stay as they are."""
    reader = Reader()
    turns = reader.read(formatted)
    reader.close()
    return turns


class Reader:
    """Reads a conversation's text back as it comes, whatever it is cut into; knows nothing of turns but their marks."""

    def __init__(self):
        self.rest = ""

    def read(self, more: str) -> list[tuple[str, str]]:
        self.rest += more
        found = list(_READ.finditer(self.rest))
        at = 0
        for m in found:
            if m.start() != at:
                raise ValueError("text between turns")
            at = m.end()
        self.rest = self.rest[at:]
        return [(unescape(m[1]), unescape(m[2])) for m in found]

    def close(self) -> None:
        if self.rest:
            raise ValueError("a turn that does not end")


def _digest(batches: Iterator) -> Iterator:
    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    begun, conv, reader, turns, loss, n, loss_chars, chars = False, None, None, None, None, 0, 0, 0
    done: list[tuple] = []

    def close():
        reader.close()
        done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for key, formatted, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or key != conv:
                if begun:
                    close()
                begun, conv, reader, turns, loss, n, loss_chars, chars = True, key, Reader(), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text in reader.read(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            masked = unescape(formatted[start:end])
            loss.update(masked.encode())
            loss_chars += len(masked)
            chars += len(formatted)
        if len(done) >= 5000:
            yield batch_of(done)
            done.clear()
    if begun:
        close()
    if done:
        yield batch_of(done)


def digests(turns: DataFrame) -> DataFrame:
    """What a reader finds in the formatted turns of each conversation."""
    return in_order(turns).select("conv", "formatted", "loss_start", "loss_end").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3(df: DataFrame) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    extra = df.sparkSession.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionAll(extra)
    return digests(format_turns(rows))


def _escaped_sql(x: str) -> str:
    out = rf"replace({x}, '\', '\\')"
    for c in CONTROL:
        out = rf"replace({out}, '{c}', '{c[0]}\{c[1:]}')"
    return out


OP3_SQL = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
),
f AS (SELECT *, '{TURN}' || {_escaped_sql('role')} || '{TEXT}' || {_escaped_sql('text')} || '{END.strip()}' || chr(10) AS formatted FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
