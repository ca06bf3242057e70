"""Definitions and unresolved references of source files, one registered extractor per language.

An extractor takes a file's text and returns definitions (kind, name, start, end,
signature, doc; offsets end-exclusive) and references (type, offset, target,
names). Nesting, qualified names, method promotion and the scope of a reference
follow from the offsets in the same way for all languages.
"""

from __future__ import annotations

import ast
import bisect
import codecs
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby, islice

import pandas as pd
from pyspark.sql import DataFrame

from graphloom.plans.lineage import ship
from graphloom.sources.languages import Bash, Go, Java, Scala, Script, TypeScript, literal

Def = tuple[str, str, int, int, str, str | None]
Ref = tuple[str, int, str, list[str]]
Extractor = Callable[[str], tuple[list[Def], list[Ref]]]

#: File endings and their languages (fixed values).
LANGUAGES = {
    ".py": "python", ".sql": "sql", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript",
    ".tsx": "tsx", ".java": "java", ".scala": "scala", ".sc": "scala", ".go": "go", ".sh": "bash", ".bash": "bash",
}
#: Methods and functions that write or read datasets (fixed values).
WRITE_METHODS = [
    "to_parquet", "to_csv", "to_sql", "to_json", "to_feather", "to_hdf", "to_pickle", "to_delta", "to_table", "saveAsTable", "save_as_table", "insertInto", "insert_into",
    "write_table", "write_parquet", "write_csv", "createOrReplaceTempView", "create_or_replace_temp_view",
]
WRITE_FUNCTIONS = ["write_table", "write_parquet", "write_csv", "save_as_table"]
READ_METHODS = [
    "read_parquet", "read_csv", "read_json", "read_sql", "read_sql_table", "read_table", "read_feather", "read_pickle", "read_delta", "read_files", "table", "load",
]
READ_FUNCTIONS = ["read_parquet", "read_csv", "read_json", "read_table"]
EXTRACTORS: dict[str, Extractor] = {}


def language(name: str) -> Callable[[Extractor], Extractor]:
    def add(f: Extractor) -> Extractor:
        EXTRACTORS[name] = f
        return f

    return add


def _blanked(line: str) -> str:
    """A line of the same number of bytes that says nothing, or pass at its indentation."""
    size = len(line.rstrip("\r\n").encode())
    end = line[len(line.rstrip("\r\n")) :]
    indent = len(line) - len(line.lstrip(" \t"))
    return (line[:indent] + "pass" if size >= indent + 4 else line[: min(indent, size)]).ljust(size) + end


def _repaired(text: str, tries: int = 20) -> tuple[str, ast.Module] | None:
    """``text`` with the lines blanked at which it can't be read on, and its tree; None if that doesn't help."""
    lines, blank = text.splitlines(keepends=True), set()
    for _ in range(tries):
        try:
            whole = "".join(lines)
            return whole, ast.parse(whole)
        except SyntaxError as e:
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            while at in blank or (at >= 0 and not lines[at].strip()):
                at -= 1
            if at < 0:
                return None
            blank.add(at)
            lines[at] = _blanked(lines[at])
        except ValueError:
            return None
    return None


def _readable(text: str) -> tuple[str, ast.Module]:
    """Python source as it is, or with what is broken blanked: line by line within statements of the top level; and its tree."""
    try:
        return text, ast.parse(text)
    except SyntaxError:
        pass
    parts: list[list[str]] = [[]]
    decorated = False
    for line in text.splitlines(keepends=True):
        if re.match(r"[^\s#)\]}]", line) and not re.match(r"(?:else|elif|except|finally)\b", line) and not decorated:
            parts.append([])
        decorated = line.startswith("@") or (decorated and not line[:1].strip())
        parts[-1].append(line)
    whole = "".join(found[0] if (found := _repaired("".join(p))) else "".join(map(_blanked, p)) for p in parts if p)
    return _repaired(whole) or ("", ast.parse(""))


def _nodes(tree: ast.Module) -> list[ast.AST]:
    """The nodes of a tree as ``ast.walk`` lists them, without contexts (load, store)."""
    out: list[ast.AST] = [tree]
    for n in out:  # grows on the way
        for field in n._fields:
            if field != "ctx":
                value = getattr(n, field, None)
                if isinstance(value, list):
                    out += [x for x in value if isinstance(x, ast.AST)]
                elif isinstance(value, ast.AST):
                    out.append(value)
    return out


_BRACKETS = re.compile(rb"\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*|[()\[\]{}]", re.S)


def _bracket_end(data: bytes, at: int) -> int:
    """The place after the bracket that closes the one at ``at``."""
    depth = 0
    for m in _BRACKETS.finditer(data, at):
        depth += (m[0] in b"([{") - (m[0] in b")]}") if len(m[0]) == 1 else 0
        if not depth:
            return m.end()
    return len(data)


def _parameters(data: bytes, at: int) -> str:
    """The parameter list of the function whose definition starts at ``at``, as it is written."""
    at = re.compile(rb"(?:async\s+)?def\s+\w+\s*").match(data, at).end()
    if data[at : at + 1] == b"[":
        at = _bracket_end(data, at)
        at += len(data[at:]) - len(data[at:].lstrip())
    return data[at : _bracket_end(data, at)].decode("utf-8", "replace")


def _comment_above(lines: list[str], line: int) -> str | None:
    """What the comment before a line says, blank lines between them or not."""
    above = next((x.strip() for x in reversed(lines[: line - 1]) if x.strip()), "")
    return (above.lstrip("/#- ").strip() or None) if above.startswith("#") else None


@language("python")
def python(text: str) -> tuple[list[Def], list[Ref]]:
    text, tree = _readable(text)
    nodes = _nodes(tree)
    lines = [0]
    for line in text.encode().splitlines(keepends=True):
        lines.append(lines[-1] + len(line))
    data, shown = text.encode(), text.splitlines()
    at = lambda line, col: lines[line - 1] + col
    source = lambda n: data[at(n.lineno, n.col_offset) : at(n.end_lineno, n.end_col_offset)].decode("utf-8", "replace")
    defs: list[Def] = []
    refs: list[Ref] = []
    # the first statement of a block has no sibling before it that could be its comment
    firsts = {id(own[0]) for n in nodes[1:] if "body" in n._fields for block in ("body", "orelse", "finalbody") if isinstance(own := getattr(n, block, None), list) and own}

    def doc(n: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) -> str | None:
        own = ast.get_docstring(n, clean=False)
        if own is not None:
            return own.strip()
        return None if n.decorator_list or id(n) in firsts else _comment_above(shown, n.lineno)

    def strings(args: list) -> list[tuple[int, str]]:
        """Places and contents of arguments that are strings; what a formatted one has in braces stays."""
        out = []
        for a in args:
            if isinstance(a, ast.Constant) and isinstance(a.value, str):
                out.append((at(a.lineno, a.col_offset), a.value.strip()))
            elif isinstance(a, ast.JoinedStr):
                out.append((at(a.lineno, a.col_offset), literal(source(a))))
        return out

    for n in nodes:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            is_class = isinstance(n, ast.ClassDef)
            begin = at(n.lineno, n.col_offset)
            defs.append(("class" if is_class else "function", n.name, begin, at(n.end_lineno, n.end_col_offset), n.name + ("" if is_class else _parameters(data, begin)), doc(n)))
            refs += [("INHERITS", at(x.lineno, x.col_offset), source(x), []) for x in getattr(n, "bases", []) if isinstance(x, ast.Name | ast.Attribute)]
        elif isinstance(n, ast.Import):
            refs += [("IMPORTS", at(n.lineno, n.col_offset), a.name, []) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            module = "." * n.level + (n.module or "")
            refs.append(("IMPORTS", at(n.lineno, n.col_offset), module, []))
            if not n.level:
                refs += [("IMPORTS", at(n.lineno, n.col_offset), module, [a.name]) for a in n.names if a.name != "*"]
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name | ast.Attribute):
            refs.append(("CALLS", at(n.func.lineno, n.func.col_offset), source(n.func), []))
            if isinstance(n.func, ast.Attribute):
                name, owner = n.func.attr, getattr(n.func.value, "attr", None)
                writes, reads = name in WRITE_METHODS, name in READ_METHODS
                first = strings(n.args[:1])
            else:
                name, owner, first = n.func.id, None, []
                writes, reads = name in WRITE_FUNCTIONS, name in READ_FUNCTIONS
            args = strings(n.args)
            for kind, all_, chained in (("PRODUCES", writes, owner == "write"), ("CONSUMES", reads, owner == "read")):
                refs += [(kind, o, v, []) for o, v in (args if all_ else []) + (first if chained else []) if v]
    return defs, refs


_SQL_PART = r"(?:[\w$]+|\"[^\"]+\"|`[^`]+`)"
_SQL_NAME = rf"({_SQL_PART}(?:\.{_SQL_PART})*)"
_SQL_WRITE = r"\b(?:create\s+(?:or\s+replace\s+)?(?:global\s+)?(?:temporary\s+|temp\s+)?(?:table|(?:materialized\s+)?view)\s+(?:if\s+not\s+exists\s+)?|insert\s+(?:into|overwrite)\s+(?:table\s+)?)"
_SQL_READ = r"\b(?:from|join)\s+(?:lateral\s+)?"


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _sql_code(text: str) -> str:
    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", _blank, text, flags=re.S)


@language("sql")
def sql(text: str) -> tuple[list[Def], list[Ref]]:
    code = _sql_code(text)
    refs: list[Ref] = []
    for kind, start in (("PRODUCES", _SQL_WRITE), ("CONSUMES", _SQL_READ)):
        refs += [(kind, m.start(1), m[1], []) for m in re.finditer(start + _SQL_NAME, code, re.I)]
    return [], refs


#: Characters of SQL that are read at once, unless a comment or something quoted is longer.
SQL_AT_ONCE = 1 << 20
#: Comments and strings that nothing that follows changes, or (in the group) what may go on.
_SQL_CLOSED = re.compile(r"--[^\n]*\n|/\*.*?\*/|'(?:[^']++|'')*+'(?=[^'])|(--|/\*|')", re.S)
#: A reference whose quoted name may go on.
_SQL_OPEN = re.compile(rf"(?:{_SQL_WRITE}|{_SQL_READ})(?:{_SQL_PART}\.)*(?:\"[^\"]*|`[^`]*)\Z", re.I)


def _sql_cut(text: str) -> int:
    """How much of the beginning of a SQL text reads the same whatever follows: up to a sign that only a comment or something quoted can hold in its midst."""
    code = _sql_code(text[: next((m.start() for m in _SQL_CLOSED.finditer(text) if m[1]), len(text))])
    at = 1 + max(code.rfind(c) for c in ";,()=")
    return 0 if _SQL_OPEN.search(code, 0, at) else at


def sql_references(pieces: Iterable[str]) -> Iterator[tuple[str, int, str]]:
    """type, line and target of the references of :func:`sql` in a text that comes in pieces, in their order and without holding it whole."""
    line = 1

    def read(text: str) -> Iterator[tuple[str, int, str]]:
        nonlocal line
        at = 0
        for kind, start, target, _ in sorted(sql(text)[1], key=lambda r: r[1]):
            line, at = line + text.count("\n", at, start), start
            yield kind, line, target
        line += text.count("\n", at)

    held, size, wanted = [], 0, SQL_AT_ONCE
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= wanted:
            text = "".join(held)
            at = _sql_cut(text)
            yield from read(text[:at])
            held, size = [text[at:]], len(text) - at
            wanted = max(SQL_AT_ONCE, 2 * size)
    yield from read("".join(held))


EXTRACTORS |= {name: lambda text, reader=reader: reader(text).read() for name, reader in (("java", Java), ("scala", Scala), ("go", Go), ("javascript", Script), ("typescript", TypeScript), ("tsx", TypeScript), ("bash", Bash))}


_NODE = dict.fromkeys(("signature", "docstring", "start_line", "end_line", "owner"))


def _module(repo: str, path: str, lang: str) -> tuple[dict, dict]:
    """The node of a file and the edge to it."""
    module = repo + "::" + path.replace("\\", "/").lstrip("./")
    return _NODE | {"id": module, "kind": "module", "name": path.rpartition("/")[2], "repo": repo, "path": path, "lang": lang}, {"type": "DEFINES", "src": repo, "dst": module}


def parse_file(repo: str, path: str, lang: str, content: bytes) -> tuple[list[dict], list[dict], list[dict]]:
    """Nodes, pending references and structural edges of one file. A file that can't be parsed is a module alone."""
    text = content.decode("utf-8", "replace")
    nodes, edges = ([x] for x in _module(repo, path, lang))
    module = nodes[0]["id"]
    try:
        defs, refs = EXTRACTORS[lang](text)
    except (SyntaxError, ValueError, RecursionError):
        return nodes, [], edges
    body = text.encode() if lang == "python" else text
    newline = [i for i, c in enumerate(body) if c in (10, "\n")]
    line = lambda at: bisect.bisect_left(newline, at) + 1
    merged: dict[tuple[int, int], Def] = {}
    for d in defs:
        first = merged.get((d[2], d[3]))
        params = [x[4][len(x[1]) :] for x in (first, d) if x]
        merged[d[2], d[3]] = d if first is None else (*first[:4], first[1] + next(filter(None, params), ""), first[5] or d[5])
    ordered = sorted(merged.values(), key=lambda d: (d[2], -d[3]))
    spans, open_ = [], []
    for kind, name, start, end, signature, doc in ordered:
        while open_ and open_[-1][1] < end:
            open_.pop()
        parent = open_[-1] if open_ else None
        qualname = f"{parent[2]}.{name}" if parent else name
        kind = "method" if kind == "function" and parent and parent[3] == "class" else kind
        open_.append((start, end, qualname, kind))
        spans.append((start, end, qualname))
        nodes.append(_NODE | {"id": f"{module}::{qualname}", "kind": kind, "name": name, "repo": repo, "path": path, "signature": signature, "docstring": doc, "start_line": line(start), "end_line": line(max(start, end - 1)), "lang": lang})
        edges.append({"type": "CONTAINS", "src": module, "dst": nodes[-1]["id"]})
    starts = [s for s, _, _ in spans]

    def scope(at: int) -> str:
        for i in range(bisect.bisect_right(starts, at) - 1, -1, -1):
            if at <= spans[i][1]:
                return spans[i][2]
        return ""

    pending = [{"type": f"{kind}_PENDING", "src_file": path, "src_scope": scope(at), "target": target, "repo": repo, "line": line(at), "names": names} for kind, at, target, names in sorted(refs, key=lambda r: r[1])]
    return nodes, pending, edges


_ROW = "part string, n int, id string, kind string, name string, repo string, path string, owner string, signature string, docstring string, start_line int, end_line int, lang string, type string, src_file string, src_scope string, target string, line int, names array<string>, src string, dst string"


#: Rows of nodes, references and edges in a batch.
BATCH_ROWS = 10_000


def _rows(repo: str, path: str, lang: str, contents: Iterable[bytes]) -> Iterator[dict]:
    """The rows of :func:`extract` of one file, whose content comes in pieces. SQL is read in passing."""
    if lang != "sql":
        found: tuple[Iterable[dict], ...] = parse_file(repo, path, lang, b"".join(contents))
    else:
        node, edge = _module(repo, path, lang)
        refs = sql_references(codecs.iterdecode(contents, "utf-8", "replace"))
        found = [node], ({"type": f"{kind}_PENDING", "src_file": path, "src_scope": "", "target": target, "repo": repo, "line": line, "names": []} for kind, line, target in refs), [edge]
    for part, own in zip(("node", "pending", "edge"), found, strict=True):
        for i, row in enumerate(own):
            yield {"path": path, **row, "part": part, "n": i}


def _frames(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _ROW.split(", ")]
    empty = dict.fromkeys(columns)
    while some := [empty | row for row in islice(rows, BATCH_ROWS)]:
        yield pd.DataFrame(some, columns=columns, dtype=object)


def extract(files: DataFrame) -> DataFrame:
    """One row per node, pending reference or edge (``part``) of the files: repo, path, lang, content."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = lambda content: (bytes(content[i : i + SQL_AT_ONCE]) for i in range(0, len(content), SQL_AT_ONCE))
        yield from _frames(row for batch in batches for repo, path, lang, content in batch[["repo", "path", "lang", "content"]].itertuples(index=False) for row in _rows(repo, path, lang, pieces(content)))

    return files.mapInPandas(run, _ROW)


def extract_pieces(pieces: DataFrame, n_parts: int) -> DataFrame:
    """:func:`extract` of files that come as several rows in an order, ``ord``, as a file may be larger than a row can be."""
    ship(pieces.sparkSession)
    file = ["repo", "path", "lang"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = chain.from_iterable(batch[[*file, "content"]].itertuples(index=False, name=None) for batch in batches)
        files = groupby(each, key=lambda r: r[:3])
        yield from _frames(row for key, own in files for row in _rows(*key, (bytes(r[3]) for r in own if r[3] is not None)))

    return pieces.repartition(n_parts, *file).sortWithinPartitions(*file, "ord", "content").select(*file, "content").mapInPandas(run, _ROW)
