"""Markdown outlines as rows, by a table function: title, tables of named sections, stages, scenes, and a summary."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import udtf

ROWS = "part string, position int, title string, fields map<string,string>, body string"
_HEADING = re.compile(r"^(#{2,3})\s+(.+?)\s*$")
_BOLD = re.compile(r"\*\*(.+?)\*\*")


@dataclass(frozen=True)
class Names:
    """What the sections of an outline are called."""

    info: str = "Info"
    settings: str = "Settings"
    notes: str = "Notes"
    structure: str = "Structure"
    scenes: str = "Scenes"


#: The sections' names in Chinese outlines.
CHINESE = Names(info="章节信息", settings="关键设定", notes="写作要点", structure="章节结构", scenes="详细场景设计")


def _cells(line: str) -> list[str]:
    """The cells of a table's line that are not empty; none for a rule or another line."""
    line = line.strip()
    if "|" not in line or line.startswith("|-"):
        return []
    return [c for c in map(str.strip, line.split("|")) if c]


def _quoted(lines: list[str]) -> str:
    """The first block of quoted lines, with blank lines in it, without those at its ends."""
    out: list[str] = []
    started = False
    for line in map(str.strip, lines):
        if line.startswith(">"):
            started = True
            out += filter(None, [line[1:].strip()])
        elif started and line:
            break
        elif started:
            out.append("")
    return "\n".join(out).strip()


class Outline:
    """The headings of a text and the lines under them."""

    def __init__(self, text: str) -> None:
        self.lines = text.splitlines()
        self.title = next((x[2:].strip() for x in self.lines if x.startswith("# ")), None)
        self.heads = [(i, len(m[1]), m[2]) for i, x in enumerate(self.lines) if (m := _HEADING.match(x))]

    def section(self, name: str, levels: tuple[int, ...] = (2, 3), to_end: bool = False) -> list[str]:
        """The lines of the first section of that name, up to the next heading of its level or a higher one."""
        for at, level, found in self.heads:
            if found == name and level in levels:
                end = next((i for i, other, _ in self.heads if i > at and other <= level), None)
                return self.lines[at + 1 : None if to_end else end]
        return []

    def table(self, name: str) -> dict[str, str]:
        """First and second cells; of equal first cells the last counts."""
        return {_BOLD.sub(r"\1", c[0]): c[1] for x in self.section(name) if len(c := _cells(x)) >= 2}

    def stages(self, name: str) -> list[dict[str, str]]:
        """The rows of a table under its header; the table may go on to the end of the text."""
        rows = [[_BOLD.sub(r"\1", c) for c in cells] for x in self.section(name, (2,), to_end=True) if (cells := _cells(x))]
        return [dict(zip(rows[0], r, strict=False)) for r in rows[1:]] if rows else []

    def scenes(self, name: str) -> list[tuple[str, str]]:
        """(title, quoted text) of the third-level sections after that heading, to the end of the text."""
        out: list[tuple[str, list[str]]] = []
        for line in self.section(name, (2,), to_end=True):
            if (m := _HEADING.match(line)) and len(m[1]) == 3:
                out.append((m[2], []))
            elif out:
                out[-1][1].append(line)
        return [(title, _quoted(lines)) for title, lines in out]


def _summary(title: str | None, tables: dict[str, dict[str, str]], scenes: list[tuple[str, str]], stages: list[dict[str, str]]) -> str:
    """A line an entry: the title, five of each table (three notes), scenes cut to 100 characters, five stages."""
    out = [title] if title else []
    for part, most in (("info", 5), ("settings", 5)):
        out += [f"{k}: {v}" for k, v in list(tables[part].items())[:most]]
    out += [f"{t}: {b[:100]}{'...' if len(b) > 100 else ''}" if b else t for t, b in scenes]
    out += [f"{k}: {v}" for k, v in list(tables["notes"].items())[:3]]
    return "\n".join(out + [" / ".join(s.values()) for s in stages[:5]])


def rows_of(text: str | None, names: Names) -> Iterator[tuple]:
    """A text's rows; a null has none."""
    if text is None:
        return
    outline = Outline(text)
    tables = {part: outline.table(getattr(names, part)) for part in ("info", "settings", "notes")}
    stages, scenes = outline.stages(names.structure), outline.scenes(names.scenes)
    if outline.title is not None:
        yield "title", 0, outline.title, None, None
    for part, fields in tables.items():
        if fields:
            yield part, 0, None, fields, None
    yield from (("stage", i, None, s, None) for i, s in enumerate(stages))
    yield from (("scene", i, title, None, body) for i, (title, body) in enumerate(scenes))
    if summary := _summary(outline.title, tables, scenes, stages):
        yield "summary", 0, None, None, summary


def outline_rows(docs: DataFrame, key: str, text: Column, names: Names = CHINESE) -> DataFrame:
    """(key, part, position, title, fields, body): the outlines of ``docs``, joined laterally with a table function."""

    @udtf(returnType=ROWS)
    class Parse:
        def eval(self, value: str):
            yield from rows_of(value, names)

    spark = docs.sparkSession
    spark.udtf.register("lexiforge_outline", Parse)
    docs.select(key, text.alias("_text")).createOrReplaceTempView("lexiforge_outlines")
    return spark.sql(f"select d.`{key}`, o.part, o.position, o.title, o.fields, o.body from lexiforge_outlines d, lateral lexiforge_outline(d._text) o")
