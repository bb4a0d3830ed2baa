"""Chat formatting with typed content parts.

A visitor folds each turn's parts (text, image, audio, document) into one text with ordered placeholders, and records
the attachments and the tokens they will expand to; a turn without parts is one text part. Turns are marked by control
strings; the same strings inside a text are escaped by one more backslash, which unescaping takes away again, so every
text reads back exactly. Text parts side by side are escaped as one, so no control string can come about at a seam.
Formatting is per turn with built-in functions; only the order of turns needs a shuffle, by conversation.

Defined results: null texts and roles are empty; a null part list means the turn's text alone; unknown part kinds
become a placeholder of 0 tokens; turns with equal numbers are ordered by role, then text; repeated rows are turns of
their own; a null conversation number is one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Control strings, with any number of backslashes after their first character when escaped.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_ESCAPED = re.compile(r"([<\[])\\(\\*)(\||/?s>|/?INST\])")
_TURN = re.compile(r"<\|turn:([^|]*)\|>\n(.*?)<\|end\|>\n", re.S)
#: Tokens: an image costs IMAGE_TOKENS per tile of TILE pixels, audio per second, a document per page.
TILE, IMAGE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 512, 170, 25, 1024
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(role, F.lit("")), "%", "%25"), r"\|", "%7C")


def _tokens(p: Column) -> Column:
    """The visitor's token count of one part, by its kind."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    image = F.ceil(zero(p["width"]) / TILE) * F.ceil(zero(p["height"]) / TILE) * IMAGE_TOKENS
    return (
        F.when(p["kind"] == "image", F.greatest(image, F.lit(IMAGE_TOKENS)))
        .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_TOKENS))
        .when(p["kind"] == "document", zero(p["pages"]) * PAGE_TOKENS)
        .otherwise(0).cast("long")
    )


def _visited(parts: Column) -> Column:
    """The visitor's text: escaped text, and a placeholder with its place in the turn for each other part."""

    def visit(seen: Column, p: Column) -> Column:
        kind = F.coalesce(F.regexp_replace(p["kind"], r"[^a-z]", ""), F.lit("unknown"))
        placeholder = F.concat(seen["done"], escape(seen["open"]), F.lit("<|"), kind, F.lit(":"), seen["k"].cast("string"), F.lit("|>"))
        is_text, text = F.coalesce(p["kind"] == "text", F.lit(False)), F.concat(seen["open"], F.coalesce(p["text"], F.lit("")))
        return F.struct(F.when(is_text, seen["done"]).otherwise(placeholder).alias("done"), F.when(is_text, text).otherwise(F.lit("")).alias("open"), (seen["k"] + 1).alias("k"))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"), F.lit(0).alias("k"))
    return F.aggregate(parts, start, visit, lambda seen: F.concat(seen["done"], escape(seen["open"])))


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per turn: conv_id, turn, formatted, in_loss, body_start and body_chars (the loss span's place in formatted, in
    code points), attachments (array of kind, uri, place, tokens), expanded_tokens."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    alone = F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).alias(x.split(":")[0]) for x in PART[7:-1].split(",")[2:]))).cast(f"array<{PART}>")
    kind = turns.schema["parts"].dataType if "parts" in turns.columns else None
    # a column of that name and another type is not a part list
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and kind.elementType.names == [x.split(":")[0] for x in PART[7:-1].split(",")]:
        parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), alone)
    else:
        parts = alone
    body = _visited(parts)
    away = F.filter(F.transform(parts, lambda p, k: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), k.alias("place"), _tokens(p).alias("tokens"))), lambda a: ~F.coalesce(a["kind"] == "text", F.lit(False)))
    away = away.cast("array<struct<kind:string,uri:string,place:int,tokens:long>>")
    head = F.concat(F.lit("<|turn:"), _role(F.col("role")), F.lit("|>\n"))
    shaped = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), text.alias("text"), head.alias("head"), body.alias("body"), away.alias("attachments"))
    return shaped.select(
        "conv_id", "turn", "role", "text", F.concat("head", "body", F.lit("<|end|>\n")).alias("formatted"),
        F.col("role").isin(*loss_roles).alias("in_loss"), F.length("head").alias("body_start"), F.length("body").alias("body_chars"),
        "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and unescaped text of one formatted turn."""
    return _parsed(_TURN.fullmatch(formatted))


def _parsed(turn: re.Match) -> tuple[str, str]:
    role, body = turn.groups()
    return role.replace("%7C", "|").replace("%25", "%"), unescape(body)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose turns arrive in order; one conversation's running digests are all that stays."""
    now: list | None = None

    def closed(c: list) -> tuple:
        return c[0], c[1], c[2].hexdigest(), c[3], c[4].hexdigest(), c[5], c[6]

    for batch in batches:
        done: list[tuple] = []
        rows = zip(*(batch.column(k).to_pylist() for k in range(6)))
        for conv, some in groupby(rows, lambda r: r[0]):
            if now is None or now[0] != conv:
                if now is not None:
                    done.append(closed(now))
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            some = list(some)
            whole, at, begin = "".join(r[1] for r in some), 0, 0
            # turns are told by their marks in the conversation's text alone
            for m in _TURN.finditer(whole):
                if m.start() != at:
                    raise ValueError("text between turns")
                role, text = _parsed(m)
                at = m.end()
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            if at != len(whole):
                raise ValueError("text after the last turn")
            for _, formatted, in_loss, start, chars, more in some:
                if in_loss:
                    masked = unescape(whole[begin + start : begin + start + chars])
                    now[3] += len(masked)
                    now[4].update(masked.encode())
                begin += len(formatted)
                now[6] += more
            now[5] += len(whole)
        if done:
            yield _rows(done)
    if now is not None:
        yield _rows([closed(now)])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in DIGEST.split(", ")])


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted turns: counts and digests of turns and of the text under the
    loss mask. A conversation's digest needs its turns in order, so they meet in one task, which streams them."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "formatted", "in_loss", "body_start", "body_chars", "expanded_tokens").mapInArrow(_digest, DIGEST)
