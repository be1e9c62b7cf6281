"""Markdown: sections, heading paths, chunks, frontmatter, links, tags and headings.

Each file is a row and is parsed where it lies: the section parser and the packing of over-long
sections are folds over the lines of one file and run over Arrow batches, all pattern extractions are
column expressions; nothing here shuffles. Code fences and frontmatter are not special to the
section parser, and a line that ends with a carriage return is no heading. Null contents count as empty.
Repeated keys give the rows of each of their files.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelattice.functions import text as tx

# The patterns of headings, links, tags and frontmatter.
HEADINGS = r"(?m)^(#{1,6})\s+([^\r\n]+)$"
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
MD_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
TAG = r"#([a-zA-Z0-9_-]+)"
FRONTMATTER = r"\A---\n([\s\S]*?)\n---\n([\s\S]+)\z"

_HEADING_LINE = re.compile(r"(#{1,6})\s+([^\r\n  ]+)")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def parse_sections(content: str) -> Iterator[tuple[int, str, str, int]]:
    """(level, heading, body, offset) of each section.

    Empty lines are dropped from bodies but count in offsets. Text before the first heading is a
    section of level 0 and offset 0; content without headings and text lines is one section of
    itself, trimmed.
    """
    level, heading, start, body, seen, at = 0, "", 0, [], False, 0
    for line in content.split("\n"):
        found = _HEADING_LINE.fullmatch(line)
        if found:
            if seen or body:
                yield level, heading, "\n".join(body).strip(), start
            level, heading, start, body, seen = len(found[1]), found[2].strip(), at, [], True
        elif line:
            body.append(line)
        at += len(line) + 1
    if seen:
        yield level, heading, "\n".join(body).strip(), start
    else:
        yield 0, "", content.strip(), 0


def with_paths(sections: Iterator[tuple[int, str, str, int]]) -> Iterator[tuple[list[str], int, str, int]]:
    """(heading path, level, body, offset): for each lower level the nearest heading before, stale ones included."""
    nearest: dict[int, str] = {}
    for level, heading, body, start in sections:
        path = [nearest[n] for n in sorted(nearest) if n < level]
        if heading:
            path.append(heading)
            nearest[level] = heading
        yield path, level, body, start


def tokens_of(text: str) -> int:
    return max(1, len(text) // 4)


def pack(path: str, body: str, most: int, overlap: int) -> Iterator[str]:
    """Texts of the chunks of one section.

    A section within ``most`` tokens is one chunk. Otherwise sentences are packed greedily; a chunk
    after the first repeats trailing sentences of the one before, as long as they stay within
    ``overlap`` tokens. A sentence is never cut; a section without sentences has no chunk.
    """
    head = f"{path}\n\n" if path else ""
    if tokens_of(head + body) <= most:
        yield head + body
        return
    fixed = tokens_of(path) + 10 if path else 0
    held: list[str] = []
    budget = fixed
    for sentence in filter(None, (s.strip() for s in _SENTENCE_END.split(body))):
        size = tokens_of(sentence)
        if held and budget + size > most:
            yield head + " ".join(held)
            kept: list[str] = []
            # the joined overlap and the next sentence are measured without a blank between them
            while len(kept) < len(held) and tokens_of(" ".join(kept) + held[-1 - len(kept)]) <= overlap:
                kept.insert(0, held[-1 - len(kept)])
            held = kept
            budget = fixed + tokens_of(" ".join(kept))
        held.append(sentence)
        budget += size
    if held:
        yield head + " ".join(held)


def _per_file(df: DataFrame, key: str, content: str, fields: list[tuple[str, T.DataType]], rows: Callable[[object, str], Iterator[tuple]]) -> DataFrame:
    schema = T.StructType([df.schema[key], *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            out = [(k, *r) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in rows(k, c or "")]
            kinds = kinds or [batch.schema.field(0).type, *(_ARROW[type(t)] for _, t in fields)]
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.fieldNames())

    return df.select(key, df[content].cast("string")).mapInArrow(run, schema)


_ARROW = {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.ArrayType: pa.list_(pa.string())}
_TEXT, _INT, _LIST = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())


def sections(df: DataFrame, key: str, content: str) -> DataFrame:
    """Rows (key, section, level, hierarchy, body, char_offset), sections numbered from 0."""

    def rows(_, text: str) -> Iterator[tuple]:
        for i, (path, level, body, start) in enumerate(with_paths(parse_sections(text))):
            yield i, level, path, body, start

    return _per_file(df, key, content, [("section", _INT), ("level", _INT), ("hierarchy", _LIST), ("body", _TEXT), ("char_offset", _INT)], rows)


def chunks(df: DataFrame, path: str, content: str, most: int = 512, overlap: int = 50) -> DataFrame:
    """Chunk rows of files: (file_path, chunk_id, heading_hierarchy, level, text, chunk_index, char_offset)."""

    def rows(name, text: str) -> Iterator[tuple]:
        index = 0
        for hierarchy, level, body, start in with_paths(parse_sections(text)):
            for chunk in pack(" > ".join(hierarchy), body, most, overlap):
                yield hashlib.md5(f"{name}:{index}".encode()).hexdigest(), hierarchy, level, chunk, index, start
                index += 1

    fields = [("chunk_id", _TEXT), ("heading_hierarchy", _LIST), ("level", _INT), ("text", _TEXT), ("chunk_index", _INT), ("char_offset", _INT)]
    return _per_file(df, path, content, fields, rows).withColumnRenamed(path, "file_path")


def title(content: Column, path: Column) -> Column:
    """The first heading of level 1, trimmed, else the file name without ``.md``."""
    first = tx.trim(F.regexp_extract(F.coalesce(content, F.lit("")), r"(?m)^#\s+([^\r\n]+)$", 1))
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md\z", "")
    return F.when(first != "", first).otherwise(name)


def frontmatter_text(content: Column) -> Column:
    """The header between the first two ``---`` lines; null if there is none or nothing follows it."""
    return F.nullif(F.regexp_extract(content, FRONTMATTER, 1), F.lit(""))


def body(content: Column) -> Column:
    """The content after the frontmatter, or all of it."""
    return F.when(frontmatter_text(content).isNotNull(), F.regexp_extract(content, FRONTMATTER, 2)).otherwise(content)


def frontmatter(content: Column) -> Column:
    """Array of (key, kind, value): kinds string, number, boolean and json; a later equal key replaces an earlier one.

    The value is JSON text for json, else plain text; an empty value is the number 0.
    """
    lines = F.filter(F.split(frontmatter_text(content), "\n"), lambda s: F.instr(s, ":") > 1)

    def parts(line: Column) -> Column:
        value = tx.trim(F.regexp_extract(line, r"\A[^:]+:([\s\S]*)\z", 1))
        return F.struct(tx.trim(F.regexp_extract(line, r"\A([^:]+):", 1)).alias("key"), value.alias("raw"))

    def entry(e: Column) -> Column:
        raw = e["raw"]
        quoted = raw.rlike(r'\A"[\s\S]*"\z') & (F.length(raw) > 1)
        number = (raw == "") | raw.rlike(r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z|\A0[xX][0-9a-fA-F]+\z|\A[+-]?Infinity\z")
        bracket = raw.rlike(r"\A[\[{]")
        kind = F.when(bracket, F.when(F.try_parse_json(raw).isNotNull(), "json").otherwise("string"))
        kind = kind.when(quoted, "string").when(raw.isin("true", "false"), "boolean").when(number, "number").otherwise("string")
        value = F.when(quoted, F.substring(raw, 2, F.length(raw) - 2)).when(raw == "", "0").otherwise(raw)
        return F.struct(e["key"].alias("key"), kind.alias("kind"), value.alias("value"))

    entries = F.transform(F.transform(lines, parts), entry)
    # folded from the left: a later equal key takes the place of the earlier one
    none = F.expr("cast(array() as array<struct<key:string,kind:string,value:string>>)")
    last = F.aggregate(entries, none, lambda kept, e: F.array_append(F.filter(kept, lambda o: o["key"] != e["key"]), e))
    return F.coalesce(last, F.expr("cast(array() as array<struct<key:string,kind:string,value:string>>)"))


def wikilinks(content: Column) -> Column:
    """Targets of double-bracket links, trimmed, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit(WIKILINK), F.lit(1)), tx.trim))


def markdown_links(content: Column) -> Column:
    """Array of (text, url), trimmed, in order, repeats kept; images match too."""
    found = lambda group: F.transform(F.regexp_extract_all(content, F.lit(MD_LINK), F.lit(group)), tx.trim)
    return F.arrays_zip(found(1).alias("text"), found(2).alias("url"))


def tags(content: Column) -> Column:
    """Words after ``#`` anywhere, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(TAG), F.lit(1)))


def headings(content: Column) -> Column:
    """Array of (level, text) of heading lines."""
    levels = F.transform(F.regexp_extract_all(content, F.lit(HEADINGS), F.lit(1)), lambda h: F.length(h))
    texts = F.transform(F.regexp_extract_all(content, F.lit(HEADINGS), F.lit(2)), tx.trim)
    return F.arrays_zip(levels.alias("level"), texts.alias("text"))


def heading_parents(found: Column) -> Column:
    """Array of (parent, child): for each heading the last one exactly one level up, unless a shallower one came between.

    One fold: of the headings before, those that no shallower or equal one followed are held, six at most.
    """
    none = F.expr("named_struct('s', cast(array() as array<struct<level:int,text:string>>), 'p', cast(array() as array<struct<parent:string,child:string>>))")

    def step(state: Column, h: Column) -> Column:
        above = F.filter(state["s"], lambda x: x["level"] < h["level"])
        top = F.try_element_at(above, F.lit(-1))
        pair = F.struct(top["text"].alias("parent"), h["text"].alias("child"))
        pairs = F.when(top["level"] == h["level"] - 1, F.array_append(state["p"], pair)).otherwise(state["p"])
        return F.struct(F.array_append(above, F.struct(h["level"].alias("level"), h["text"].alias("text"))).alias("s"), pairs.alias("p"))

    return F.aggregate(found, none, step, lambda state: state["p"])
