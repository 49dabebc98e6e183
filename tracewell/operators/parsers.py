"""Sequential parsers: one text in, rows out.  A text is the unit, its length bounds the memory.

They run in Arrow batches over whole texts (`per_text`); nothing is shuffled.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def per_text(docs: DataFrame, key: str, text: str, schema: str, parse: Callable[[str], list[tuple]]) -> DataFrame:
    """(key, *schema): the rows that parse gives for each text; null is an empty text."""
    types = StructType([*docs.select(key).schema.fields, *StructType.fromDDL(schema).fields])
    names = types.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        for b in batches:
            rows = [(k, *r) for k, t in zip(b.column(key).to_pylist(), b.column(text).to_pylist()) for r in parse(t or "")]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], names=names)

    return docs.select(key, text).mapInArrow(run, types)


HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
DIFF = "path string, hunks long, adds long, dels long, short_hunks long"


def diff_census(t: str) -> list[tuple]:
    """(path, hunks, adds, dels, short hunks) of each file of a unified diff.

    A hunk owns as many old and new lines as its header says, whatever they look like; it is short if it ends before.
    """
    files: dict[str, list[int]] = {}
    order, path, old, new = [], "", 0, 0
    lines = t.removesuffix("\n").split("\n")
    for i, line in enumerate(lines):
        inside = old > 0 or new > 0
        header = line.startswith("--- ") and i + 1 < len(lines) and lines[i + 1].startswith("+++ ") and (i + 2 >= len(lines) or lines[i + 2].startswith("@@"))
        if inside and (header or HUNK.match(line)):
            files[path][3] += 1
            inside, old, new = False, 0, 0
        if inside:
            if line.startswith("+"):
                files[path][1] += 1
                new -= 1
            elif line.startswith("-"):
                files[path][2] += 1
                old -= 1
            elif not line.startswith("\\"):
                old, new = old - 1, new - 1
        elif line.startswith("+++ "):
            path = re.sub(r"^[ab]/", "", line[4:].split("\t")[0].strip())
            if path == "/dev/null" and i:
                path = re.sub(r"^[ab]/", "", lines[i - 1][4:].split("\t")[0].strip())
            if path not in files:
                files[path] = [0, 0, 0, 0]
                order.append(path)
        elif (m := HUNK.match(line)) and path:
            files[path][0] += 1
            old, new = int(m[1] or 1), int(m[2] or 1)
    if path and (old > 0 or new > 0):
        files[path][3] += 1
    return [(p, *files[p]) for p in order]


FRAME = re.compile(r'\s+File "([^"]+)", line (\d+), in (\S+)|\s+at (\S+)\(([\w.]+):(\d+)\)')
TRACE = "trace long, frames long, shown long, repeats long, period long, error string"


def collapsed(frames: list[str], most: int = 8, least: int = 3) -> list[tuple[list[str], int]]:
    """Runs of frames: at each place the period of 1 to `most` with at least `least` repetitions that covers most."""
    out, i = [], 0
    while i < len(frames):
        best = (0, 0, 0)
        for p in range(1, most + 1):
            n = 1
            while frames[i + n * p : i + (n + 1) * p] == frames[i : i + p] and i + (n + 1) * p <= len(frames):
                n += 1
            if n >= least and n * p > best[0]:
                best = (n * p, p, n)
        if best[0]:
            out.append((frames[i : i + best[1]], best[2]))
            i += best[0]
        else:
            out.append(([frames[i]], 1))
            i += 1
    return out


def traces(t: str) -> list[tuple]:
    """(trace, frames, frames shown after collapse, most repeats, their period, error line) of each stack trace."""
    out: list[tuple] = []
    frames: list[str] = []

    def close(error: str) -> None:
        if frames:
            runs = collapsed(frames)
            top = max(runs, key=lambda r: r[1])
            out.append((len(out), len(frames), sum(len(r[0]) for r in runs), top[1], len(top[0]), error))
            frames.clear()

    for line in t.split("\n"):
        if m := FRAME.match(line):
            frames.append(f"{m[1] or m[4]}:{m[2] or m[6]}")
        elif (m := re.match(r"\s*\[Previous line repeated (\d+) more times\]", line)) and frames:
            frames += [frames[-1]] * int(m[1])
        elif frames and line and not line[0].isspace():
            close(line.strip())
    close("")
    return out


TESTS = "test string, outcome string, error string, file string, line long"


def pytest_report(t: str) -> list[tuple]:
    """(test, outcome, error class, file, line) of each failing test of a report.

    Blocks go from one ___ name ___ header to the next header or banner; the last file:line in a block is its place; a
    block's test is the first unused id of the summary that ends with its name.
    """
    summary = [(m[2], m[1]) for m in re.finditer(r"^(FAILED|ERROR) (\S+)", t, re.M)]
    heads = list(re.finditer(r"^_{3,} (.+?) _{3,}$|^=+ .* =+$", t, re.M))
    used: set[int] = set()
    out = []
    for h, nxt in zip(heads, [*heads[1:], None]):
        if not h[1]:
            continue
        body = t[h.end() : nxt.start() if nxt else len(t)]
        name = "::" + h[1].replace(".", "::")
        k = next((i for i, (s, _) in enumerate(summary) if i not in used and ("::" + s).endswith(name)), None)
        if k is not None:
            used.add(k)
        error = re.search(r"^E\s+(\w+(?:Error|Exception|Exit))\b", body, re.M)
        places = re.findall(r"^(\S+):(\d+):", body, re.M)
        file, line = (places[-1][0], int(places[-1][1])) if places else (None, None)
        out.append((summary[k][0] if k is not None else h[1], summary[k][1] if k is not None else "FAILED", error[1] if error else None, file, line))
    out += [(s, o, None, None, None) for i, (s, o) in enumerate(summary) if i not in used]
    return out


CHUNKS = "chunk long, first long, last long, bytes long"


def chunk_map(t: str, target: int = 1200, most: int = 2400, most_lines: int = 240) -> list[tuple]:
    """(chunk, first line, last line, bytes): cut at a blank line or heading once `target` is reached, at `most` anyway."""
    out: list[tuple] = []
    lines = t.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    start = size = 0
    for i, line in enumerate(lines):
        n = len(line.encode()) + 1
        if i > start and (size + n > most or i - start >= most_lines or (size >= target and (not line.strip() or line.startswith("#")))):
            out.append((len(out), start + 1, i, size))
            start, size = i, 0
        size += n
    if size:
        out.append((len(out), start + 1, len(lines), size))
    return out


BLOCKS = "block long, kind string, level long, first long, last long, parent long, text string"


def blocks(t: str) -> list[tuple]:
    """(block, kind, level, first, last, heading above it, text): headings, fenced code and paragraphs."""
    out: list[tuple] = []
    stack: list[tuple[int, int]] = []
    held: list[str] = []
    first, fence = 1, ""

    def close(last: int, kind: str) -> None:
        if held:
            out.append((len(out), kind, 0, first, last, stack[-1][1] if stack else None, "\n".join(held)))
            held.clear()

    for i, line in enumerate(t.split("\n"), 1):
        if fence:
            held.append(line)
            if line.strip() == fence:
                close(i, "code")
                fence = ""
        elif m := re.match(r"(`{3,}|~{3,})", line):
            close(i - 1, "text")
            first, fence = i, m[1]
            held.append(line)
        elif m := re.match(r"(#{1,6})\s+\S", line):
            close(i - 1, "text")
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            out.append((len(out), "heading", len(m[1]), i, i, stack[-1][1] if stack else None, line))
            stack.append((len(m[1]), len(out) - 1))
        elif not line.strip():
            close(i - 1, "text")
        else:
            if not held:
                first = i
            held.append(line)
    close(len(t.split("\n")), "code" if fence else "text")
    return out


SELECTED = "block long, bytes long"


def select_blocks(wanted: list[str], room: int) -> Callable[[str], list[tuple]]:
    """Blocks by relevance (sum of 1 / df of wanted words), each with the headings above it, as long as they fit."""

    def go(t: str) -> list[tuple]:
        bs = blocks(t)
        words = [set(re.findall(r"[a-z0-9_]+", b[6].lower())) & set(wanted) for b in bs]
        df = {w: sum(w in x for x in words) for w in wanted}
        score = [sum(1 / df[w] for w in sorted(x)) for x in words]
        taken: set[int] = set()
        used = 0
        for i in sorted((i for i in range(len(bs)) if score[i] > 0), key=lambda i: (-score[i], i)):
            need, at = {i}, bs[i][5]
            while at is not None:
                need.add(at)
                at = bs[at][5]
            cost = sum(len(bs[j][6].encode()) + 1 for j in need - taken)
            if used + cost <= room:
                used += cost
                taken |= need
        return [(i, len(bs[i][6].encode()) + 1) for i in sorted(taken)]

    return go


SYMBOLS = "symbol string, kind string, line_a long, line_b long, scope string"


def python_symbols(t: str) -> list[tuple]:
    """(symbol, kind, first, last, scope) of the classes and functions of Python source; none if it does not parse."""
    out: list[tuple] = []

    def visit(node: ast.AST, scope: str) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{scope}.{x.name}" if scope else x.name
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if scope else "function"
                out.append((name, kind, x.lineno, x.end_lineno, scope or None))
                visit(x, name)
            else:
                visit(x, scope)

    try:
        visit(ast.parse(t), "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    return out
