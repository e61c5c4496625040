"""Symbols, references and imports of source files, and the graph that they make.

Python is parsed by the standard library's `ast`. No grammars are at hand for the other languages: `lex` reads their tokens and goes
over them once with a stack of open brackets. What a macro makes isn't seen, and types aren't resolved.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomgraph.functions.scalars import is_test_path, parent_dir, symbol_id
from loomgraph.operators import source_text as tx
from loomgraph.operators.lex import Outline
from loomgraph.sources.tables import ship, spread, written

#: Languages by file extension; files above this many bytes and these folders aren't read.
LANGUAGES = {
    "rs": "rust", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "go": "go", "java": "java", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "h": "cpp",
}
MOST_BYTES = 2 * 1024 * 1024
NESTED = b"\0<nested>\0"
NEWLINE = re.compile(b"\n")
CALLABLE = ("function", "method")
#: Nodes of Python's trees that define functions, and those with nothing below them that is looked for.
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
LEAVES = frozenset((ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.alias, ast.Pass))
#: Fields that hold no nodes, or only such as are leaves or have nothing below them.
PLAIN = frozenset(("ctx", "id", "attr", "name", "names", "arg", "asname", "level", "module", "op", "ops", "type_comment", "type_ignores", "conversion", "simple", "is_async"))
NODE_FIELDS: dict[type, tuple[str, ...]] = {}


def node_fields(kind: type) -> tuple[str, ...]:
    """The fields of a kind of nodes in which others are."""
    found = NODE_FIELDS[kind] = tuple(x for x in kind._fields if x not in PLAIN)
    return found


def language(path: Column) -> Column:
    """The language of a path by its extension in any case; null without one."""
    ext = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[ext]


def is_indexable(path: Column) -> Column:
    """Whether a scan reads a file: a source, a .sql file or a manifest."""
    return language(path).isNotNull() | F.lower(path).endswith(".sql") | F.regexp_extract(path, "([^/]*)$", 1).isin(*tx.MANIFESTS)


def short_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]


def elided_hash(data: bytes, start: int, end: int, spans: list[tuple[int, int]]) -> str:
    """Hash of a span with each directly nested one replaced by a mark, so that a change inside one isn't a change of what holds it."""
    out, at = [], start
    for a, b in sorted(spans):
        if a >= at:
            out += [data[at:a], NESTED]
            at = b
    return short_hash(b"".join([*out, data[at:end]]))


def _python(data: bytes) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Definitions (kind, name, start, end), references (name, kind, start, end) and imports (specifier, byte)."""
    tree = ast.parse(data)
    starts = [0]
    for line in data.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    span = lambda n: (starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset)
    defs, refs, imports = [], [], []
    for node in tree.body:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            defs.append(("constant", node.targets[0].id, *span(node)))
    todo = [tree]
    for node in todo:  # in breadth, as ast.walk goes, without the leaves that are looked for nowhere
        kind = node.__class__
        if kind is ast.ClassDef:
            defs.append(("class", node.name, *span(node)))
        elif kind in FUNCTIONS:
            defs.append(("function", node.name, *span(node)))
        elif kind is ast.Call:
            f = node.func
            if isinstance(f, ast.Name | ast.Attribute):
                refs.append((f.id if isinstance(f, ast.Name) else f.attr, "calls", *span(node)))
        elif kind is ast.Import:
            imports += [(a.name, span(node)[0] + i) for i, a in enumerate(node.names)]
        elif kind is ast.ImportFrom:
            imports.append(("." * node.level + (node.module or ""), span(node)[0]))
        for name in NODE_FIELDS.get(kind) or node_fields(kind):
            x = getattr(node, name, None)
            if x.__class__ is list:
                for y in x:
                    if y.__class__ not in LEAVES and isinstance(y, ast.AST):
                        todo.append(y)
            elif x is not None and x.__class__ not in LEAVES and isinstance(x, ast.AST):
                todo.append(x)
    return defs, refs, imports


def byte_positions(text: str, positions: Iterable[int]) -> dict[int, int]:
    """Where positions of a text lie in its bytes; one pass over the text for all of them."""
    if text.isascii():
        return {x: x for x in positions}
    out, before, size = {}, 0, 0
    for x in sorted(set(positions)):
        size += len(text[before:x].encode("utf-8", "surrogatepass"))
        out[x], before = size, x
    return out


def _bracketed(text: str, lang: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """The same for languages with brackets; positions are bytes."""
    found = Outline(text, "typescript" if lang == "tsx" else lang)
    at = byte_positions(text, [x for d in (*found.defs, *found.refs) for x in d[2:]] + [x for _, x in found.imports])
    spans = lambda rows: [(a, b, at[x], at[y]) for a, b, x, y in rows]
    return spans(found.defs), spans(found.refs), [(s.strip(), at[x]) for s, x in found.imports]


def nest(defs: list[tuple], data: bytes) -> list[dict]:
    """Definitions as a containment tree with qualified names, outermost first.

    A definition inside one of the same name is the same declaration seen twice; the outer one counts.
    """
    out: list[dict] = []
    trail: list[int] = []
    seen: Counter = Counter()
    lines = [m.start() for m in NEWLINE.finditer(data)]
    for kind, name, start, end in sorted(set(defs), key=lambda d: (d[2], -d[3], d[0], d[1])):
        while trail and start >= out[trail[-1]]["end"]:
            trail.pop()
        holder = out[trail[-1]] if trail else None
        if holder and holder["name"] == name and end <= holder["end"]:
            continue
        fqn = f"{holder['fqn']}.{name}" if holder else name
        out.append({"kind": kind, "name": name, "fqn": fqn, "parent": trail[-1] if trail else -1, "start": start, "end": end, "start_line": bisect_left(lines, start), "end_line": bisect_left(lines, end), "body_hash": short_hash(data[start:end]), "disambiguator": seen[kind, fqn]})
        seen[kind, fqn] += 1
        trail.append(len(out) - 1)
    inner: dict[int, list[tuple[int, int]]] = {}
    for s in out:
        inner.setdefault(s["parent"], []).append((s["start"], s["end"]))
    for i, s in enumerate(out):
        s["own_hash"] = elided_hash(data, s["start"], s["end"], inner.get(i, []))
    return out


def owners(symbols: list[dict], spans: list[tuple[int, int]]) -> list[int]:
    """Index of the innermost symbol that holds each span; -1: the file. Symbols and spans are swept together by their starts, with a stack of the symbols that are open."""
    out, open_, n = [-1] * len(spans), [], 0
    for k in sorted(range(len(spans)), key=lambda k: spans[k]):
        start, end = spans[k]
        while n < len(symbols) and symbols[n]["start"] <= start:
            while open_ and symbols[open_[-1]]["end"] <= symbols[n]["start"]:
                open_.pop()
            open_.append(n)
            n += 1
        while open_ and symbols[open_[-1]]["end"] <= start:
            open_.pop()
        out[k] = next((i for i in reversed(open_) if end <= symbols[i]["end"]), -1)
    return out


#: Marks above a test and the frameworks they tell of, the first that is there counting; beginnings of a test's name;
#: how many bytes above a symbol are looked at, and how far behind a route the symbol it annotates begins at most.
TEST_MARKS = ((b"#[test]", "rust"), (b"#[tokio::test]", "rust"), (b"@Test", "junit"), (b"[Fact]", "xunit"), (b"[Test]", "xunit"))
TEST_NAMES = ("test_", "Test")
ABOVE, ANNOTATES = 200, 400


def roles(path: str, text: str, symbols: list[dict]) -> None:
    """Sets role and meta of a file's symbols: tests by a mark above them, their name or their path; endpoints, which win, by their routes."""
    data, in_tests = text.encode("utf-8", "surrogatepass"), _test_path(path)
    ends, starts = sorted(s["end"] for s in symbols), [s["start"] for s in symbols]
    for s in symbols:
        s["role"], s["meta"], framework = None, None, None
        if s["kind"] in CALLABLE:
            # What stands above belongs to the symbol before if that ends there.
            before = bisect_right(ends, s["start"])
            above = data[max(s["start"] - ABOVE, ends[before - 1] if before else 0) : s["start"]]
            named = "naming" if s["name"].startswith(TEST_NAMES) else "path" if in_tests else None
            framework = next((f for mark, f in TEST_MARKS if mark in above), named)
        if framework:
            s["role"], s["meta"] = "test", json.dumps({"framework": framework})
    declared = tx.route_hits(text)
    if not declared:
        return
    at = byte_positions(text, [h[0] for h in declared])
    by_name: dict[str, int] = {}
    for i, s in enumerate(symbols):
        by_name.setdefault(s["name"], i)
    found: dict[int, list[dict]] = {}
    for (place, method, route, handler), around in zip(declared, owners(symbols, [(at[h[0]], at[h[0]] + 1) for h in declared]), strict=True):
        nxt = bisect_left(starts, at[place])
        follows = nxt if nxt < len(symbols) and starts[nxt] - at[place] < ANNOTATES else -1
        i = by_name.get(handler, around if around >= 0 else follows) if handler else around if around >= 0 else follows
        one = {"method": method, "path": route}
        if i >= 0 and one not in found.setdefault(i, []):
            found[i].append(one)
    for i, metas in found.items():
        symbols[i]["role"], symbols[i]["meta"] = "api", json.dumps(metas[0] if len(metas) == 1 else {**metas[0], "routes": metas})


def _test_path(path: str) -> bool:
    p = path.lower()
    name = p.rpartition("/")[2]
    return bool(re.search(r"(^|/)tests?/", p)) or "/__tests__/" in p or name.startswith("test_") or bool(re.search(r"(_test\.(py|go|rs)|test\.java|tests\.cs)$", name)) or ".test." in name or ".spec." in name


def parse_text(path: str, text: str) -> dict | None:
    """Everything that is read off one file; None where it can't be parsed or has no known language."""
    lang = LANGUAGES.get(path.rpartition(".")[2].lower()) if "." in path else None
    if lang is None:
        return None
    data = text.encode("utf-8", "surrogatepass")
    try:
        defs, refs, imports = _python(data) if lang == "python" else _bracketed(text, lang)
    except (SyntaxError, ValueError, RecursionError):
        return None
    symbols = nest(defs, data)
    roles(path, text, symbols)
    specifiers = [s for s, _ in sorted(set(imports), key=lambda x: x[1])]
    asking = symbols if tx.may_name_tables(text) else []
    return {
        "lang": lang, "content_hash": short_hash(data), "own_hash": elided_hash(data, 0, len(data), [(s["start"], s["end"]) for s in symbols if s["parent"] < 0]),
        "symbols": symbols, "refs": [{"name": n, "kind": k, "owner": i} for (n, k, _, _), i in zip(refs, owners(symbols, [r[2:] for r in refs]), strict=True)], "imports": [s for i, s in enumerate(specifiers) if s and s not in specifiers[:i]],
        "tables": [{"owner": i, "name": t} for i, s in enumerate(asking) if tx.may_name_tables(own := data[s["start"] : s["end"]].decode("utf-8", "ignore")) for t in sorted(set(tx.tables_named(own)))],
    }


SYMBOL = "struct<kind: string, name: string, fqn: string, parent: int, start: long, end: long, start_line: long, end_line: long, body_hash: string, own_hash: string, disambiguator: long, role: string, meta: string>"
PARSED = f"path string, lang string, content_hash string, own_hash string, parsed boolean, symbols array<{SYMBOL}>, refs array<struct<name: string, kind: string, owner: int>>, imports array<string>, tables array<struct<owner: int, name: string>>"


def parse_files(files: DataFrame) -> DataFrame:
    """A row for each source file of files (path, text) with what is read off it; `parsed` is false where it can't be.

    Files of other kinds give no row. A file is parsed by itself, so the work is spread by file: a listing is small beside the work
    that it stands for, and Spark would read one of many thousand files in a task or two.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = parse_text(path, text or "")
                rows.append({"path": path, "parsed": made is not None, **(made or {"lang": LANGUAGES.get(path.rpartition(".")[2].lower())})})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(PARSED))
    return spread(files.filter(language(F.col("path")).isNotNull()).select("path", "text"), "path").mapInArrow(run, PARSED)


def parse_once(files: DataFrame) -> DataFrame:
    """parse_files() as a table, for what reads it more than once: a plan that names it twice would parse everything twice."""
    return written(parse_files(files), "parsed")


def symbols_of(parsed: DataFrame, repo: str = "R1") -> DataFrame:
    """Files and symbols as rows of the model: (id, path, lang, kind, name, fqn, parent_id, start_byte, end_byte, start_line, end_line, body_hash, own_hash, role, meta, disambiguator, repo_id)."""
    r = F.lit(repo)
    file_id = symbol_id(r, F.col("path"), F.lit("file"), F.col("path"), F.lit(0))
    file_role = F.when(is_test_path(F.col("path")), "test")
    ids = F.transform("symbols", lambda s: symbol_id(r, F.col("path"), s["kind"], s["fqn"], s["disambiguator"]))
    # Ids are made before the symbols become rows: beside the rows, Spark would make all of a file's ids again for each.
    named = parsed.filter("parsed").select("path", "lang", "content_hash", F.col("own_hash").alias("file_hash"), file_id.alias("file_id"), ids.alias("ids"), "symbols")
    # The file itself stands before its symbols, so that all come of one reading of what may still have to be parsed.
    held = F.posexplode(F.concat(F.array(F.lit(None).cast(SYMBOL)), "symbols")).alias("i", "s")
    rows = named.select("path", "lang", "content_hash", "file_hash", "file_id", "ids", held)
    own, none = F.col("i") == 0, F.lit(0).cast("long")
    either = lambda of_file, name: F.when(own, of_file).otherwise(F.col(f"s.{name}")).alias(name)
    of = lambda at: F.get("ids", at)
    parent = F.when(~own, F.when(F.col("s.parent") < 0, F.col("file_id")).otherwise(of(F.col("s.parent"))))
    return rows.select(
        F.when(own, F.col("file_id")).otherwise(of(F.col("i") - 1)).alias("id"), "path", "lang", either(F.lit("file"), "kind"), either(F.regexp_extract("path", "([^/]*)$", 1), "name"), either(F.col("path"), "fqn"), parent.alias("parent_id"),
        either(none, "start").alias("start_byte"), either(none, "end").alias("end_byte"), either(none, "start_line"), either(none, "end_line"), either(F.col("content_hash"), "body_hash"), either(F.col("file_hash"), "own_hash"), either(file_role, "role"), F.col("s.meta").alias("meta"), either(none, "disambiguator"), r.alias("repo_id"),
    )


def _owned(parsed: DataFrame, column: str, repo: str) -> DataFrame:
    """(path, src, src_role, x) of a list of things with an owner; without one they are the file's."""
    r = F.lit(repo)
    ids = F.transform("symbols", lambda s: symbol_id(r, F.col("path"), s["kind"], s["fqn"], s["disambiguator"]))
    file_id = symbol_id(r, F.col("path"), F.lit("file"), F.col("path"), F.lit(0))
    rows = parsed.select("path", file_id.alias("file_id"), ids.alias("ids"), F.col("symbols.role").alias("roles"), column).select("path", "file_id", "ids", "roles", F.explode(column).alias("x"))
    own = F.col("x.owner") >= 0
    return rows.select("path", F.when(own, F.col("ids")[F.col("x.owner")]).otherwise(F.col("file_id")).alias("src"), F.when(own, F.col("roles")[F.col("x.owner")]).alias("src_role"), "x")


#: Extensions a script's import is tried with, in order.
SCRIPT_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def _clean(path: str) -> str:
    out: list[str] = []
    for p in path.split("/"):
        if p == "..":
            out[-1:] = []
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


def _up(path: str) -> str:
    return path.rpartition("/")[0]


def import_candidates(lang: str, path: str, spec: str) -> list[str]:
    """Files an import may mean, best first, where they follow from the two paths alone."""
    folder = _up(path)
    at = lambda d, x: _clean(f"{d}/{x}")
    if lang in ("typescript", "tsx", "javascript"):
        if not spec.startswith((".", "/", "~")):
            return []
        base = at(folder, spec.lstrip("~").lstrip("/"))
        tried = [base] + [f for e in SCRIPT_EXTENSIONS for f in (f"{base}.{e}", f"{base}/index.{e}")]
        return tried + ([f"{base[:-3]}.ts", f"{base[:-3]}.tsx"] if base.endswith(".js") else [])
    if lang == "python":
        dots = len(spec) - len(spec.lstrip("."))
        rest = spec[dots:].replace(".", "/")
        if not rest:
            return []
        if dots:
            for _ in range(dots - 1):
                folder = _up(folder)
            folders = [folder]
        else:
            folders = ["", folder]
            while folder:
                folder = _up(folder)
                folders.append(folder)
        return [at(f, x) for f in folders for x in (f"{rest}.py", f"{rest}/__init__.py")]
    if lang == "rust":
        parts = [p for p in spec.partition("{")[0].partition(" as ")[0].strip().split("::") if p and p != "*"]
        if not parts:
            return []
        if len(parts) == 1 and "::" not in spec:
            stem = path.removesuffix(".rs")
            return [at(d, x) for d in (folder, stem) for x in (f"{spec}.rs", f"{spec}/mod.rs")]
        top = path.split("/")
        root = "/".join(top[: len(top) - 1 - top[::-1].index("src")] + ["src"]) if "src" in top[:-1] else folder
        root, rest = {"crate": (root, parts[1:]), "self": (folder, parts[1:]), "super": (_up(folder), parts[1:])}.get(parts[0], (root, parts))
        return [at(root, "/".join(rest[:n]) + end) for n in range(len(rest), 0, -1) for end in (".rs", "/mod.rs")]
    if lang == "cpp":
        return [at(folder, spec), spec]
    return []


def resolve_imports(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, specifier, target): the repository's files that the imports of parsed files mean. files: (path) of all indexed ones.

    parsed: a table, as it is read several times (parse_once).
    What follows from the two paths alone is a list of candidates, of which the first that exists counts. A Java or C# type,
    and an include that no path leads to, mean the one file of that name; a Go import the files of the folder that ends with
    most of it. Others are of third parties.
    """
    ship(parsed.sparkSession)
    schema = "path string, lang string, specifier string, rank int, candidate string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "lang", "specifier", "rank", "candidate"]
        for batch in batches:
            rows = [dict(zip(names, (p, lang, s, i, c), strict=True)) for p, lang, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for i, c in enumerate(import_candidates(lang, p, s))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("lang", pa.string()), ("specifier", pa.string()), ("rank", pa.int32()), ("candidate", pa.string())]))

    imports = parsed.select("path", "lang", F.explode("imports").alias("specifier"))
    known = files.select(F.col("path").alias("target")).distinct()
    tried = imports.mapInArrow(run, schema)
    direct = tried.join(known, F.col("candidate") == F.col("target")).groupBy("path", "specifier").agg(F.min_by("target", "rank").alias("target"))

    name = F.regexp_extract("target", "([^/]*)$", 1)
    unique = known.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).filter("n = 1").select("file", "target")
    last = F.regexp_extract("specifier", r"([^./]*)$", 1)
    typed = imports.filter("lang in ('java', 'csharp')").withColumn("file", F.concat(last, F.when(F.col("lang") == "java", ".java").otherwise(".cs"))).filter(last != "")
    lost = imports.filter("lang = 'cpp'").join(direct.select("path", "specifier"), ["path", "specifier"], "left_anti").withColumn("file", F.regexp_extract("specifier", "([^/]*)$", 1))
    by_name = typed.unionByName(lost).join(unique, "file").select("path", "specifier", "target")

    tails = lambda x: F.transform(F.sequence(F.lit(1), F.size(F.split(x, "/"))), lambda n: F.array_join(F.slice(F.split(x, "/"), n, F.size(F.split(x, "/"))), "/"))
    folders = known.filter(F.col("target").endswith(".go")).select("target", F.explode(tails(parent_dir(F.col("target")))).alias("tail"))
    wanted = imports.filter("lang = 'go'").select("path", "specifier", F.posexplode(tails(F.col("specifier"))).alias("rank", "tail"))
    best = wanted.join(folders.select("tail").distinct(), "tail").groupBy("path", "specifier").agg(F.min_by("tail", "rank").alias("tail"))
    go = best.join(folders, "tail").select("path", "specifier", "target")
    return direct.unionByName(by_name).unionByName(go).distinct()


def resolve_references(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """refs (path, name, …) with dst: the one symbol of that name in the file; without any, the one in what the file imports; without any, the one in the repository. Others are left out.

    symbols: (id, path, name) that can be meant. Counts are taken by name before anything is joined, so a common name is one row.
    """
    here = symbols.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"))
    everywhere = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n_all"), F.min("id").alias("any"))
    keys = refs.select("path", "name").distinct()
    local = keys.join(here.select("path", "name", F.col("n").alias("n_here"), F.col("one").alias("local")), ["path", "name"], "left")
    met = local.filter("n_here is null").select("path", "name").join(imports.select("path", "target").distinct(), "path")
    met = met.join(here.select(F.col("path").alias("target"), "name", "n", "one"), ["target", "name"]).groupBy("path", "name").agg(F.sum("n").alias("n_imported"), F.min("one").alias("imported"))
    all_ = local.join(met, ["path", "name"], "left").join(everywhere, "name")
    dst = F.when(F.col("n_here") == 1, F.col("local")).when(F.col("n_here").isNull() & (F.col("n_imported") == 1), F.col("imported")).when(F.col("n_here").isNull() & F.col("n_imported").isNull() & (F.col("n_all") == 1), F.col("any"))
    return refs.join(all_.select("path", "name", dst.alias("dst")).filter("dst is not null"), ["path", "name"])


def build_edges(parsed: DataFrame, symbols: DataFrame, imports: DataFrame, tables: DataFrame, repo: str = "R1") -> DataFrame:
    """(src, dst, kind) of parsed files, each once: contains, imports, calls and uses, tests (calls from a test), queries; none to itself.

    symbols: all of the repository; imports: from resolve_imports; tables: (id, name).
    """
    file_id = lambda x: symbol_id(F.lit(repo), x, F.lit("file"), x, F.lit(0))
    mine = symbols.join(parsed.filter("parsed").select("path"), "path", "left_semi")
    contains = mine.filter("kind not in ('file', 'service', 'table')").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"))
    imported = imports.filter("path <> target").select(file_id(F.col("path")).alias("src"), file_id(F.col("target")).alias("dst"), F.lit("imports").alias("kind"))
    refs = _owned(parsed, "refs", repo).select("path", "src", "src_role", "x.name", "x.kind")
    named = symbols.filter("kind not in ('file', 'service', 'table')").select("id", "path", "name")
    met = resolve_references(refs, named, imports.filter("path <> target")).filter("src <> dst")
    calls = met.select("src", "dst", F.when((F.col("src_role") == "test") & (F.col("kind") == "calls"), "tests").otherwise(F.col("kind")).alias("kind"))
    asked = _owned(parsed, "tables", repo).select("src", F.col("x.name").alias("name"))
    queries = asked.join(tables.select("name", F.col("id").alias("dst")), "name").select("src", "dst", F.lit("queries").alias("kind"))
    return contains.unionByName(imported).unionByName(calls).unionByName(queries).distinct()


def table_symbols(files: DataFrame, repo: str = "R1") -> DataFrame:
    """(id, path, name, line) of the tables that .sql files define."""
    made = tx.tables_defined(files.filter(F.lower("path").endswith(".sql")))
    return made.select(symbol_id(F.lit(repo), F.col("path"), F.lit("table"), F.col("table"), F.lit(0)).alias("id"), "path", F.col("table").alias("name"), "line")


def scan(present: DataFrame, stored_files: DataFrame | None = None, stored_symbols: DataFrame | None = None, *, repo: str = "R1", full: bool = True, force: bool = False) -> dict[str, DataFrame]:
    """The index after a scan: files, symbols, edges of the files read, dropped (ids of symbols that are gone), stats (one row).

    present: (path, text) of the files that are there, or with full=False only of those to look at. Files whose hash is
    stored are not read again unless `force`. Only a full scan takes away files that are gone.
    """
    sources = present.filter(is_indexable(F.col("path"))).filter(F.octet_length("text") <= MOST_BYTES).withColumn("content_hash", F.substring(F.sha2("text", 256), 1, 16))
    fresh, listed, new = sources, sources.select("path", "content_hash"), sources.select("path")
    if stored_files is not None:
        # The listing is small and asked again and again; the texts behind it are read for what is new only.
        listed = written(listed, "listed")
        changed = listed if force else written(listed.join(stored_files.select("path", "content_hash"), ["path", "content_hash"], "left_anti"), "new-files")
        fresh, new = sources.join(changed, ["path", "content_hash"], "left_semi"), changed.select("path")
    parsed = parse_once(fresh)  # it is read for symbols, references, imports and counts
    made = symbols_of(parsed, repo)
    tables = table_symbols(fresh, repo)
    null = F.lit(None).cast("string")
    made = made.unionByName(tables.select("id", "path", F.lit("sql").alias("lang"), F.lit("table").alias("kind"), "name", F.col("name").alias("fqn"), null.alias("parent_id"), F.lit(0).cast("long").alias("start_byte"), F.lit(0).cast("long").alias("end_byte"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), null.alias("body_hash"), null.alias("own_hash"), F.lit("schema").alias("role"), null.alias("meta"), F.lit(0).cast("long").alias("disambiguator"), F.lit(repo).alias("repo_id")))
    own = tx.manifests(sources)
    symbols, files, dropped = made, listed, None
    if stored_files is not None:
        kept_files = stored_files.select("path", "content_hash").join(new, "path", "left_anti")
        if full:
            kept_files = kept_files.join(listed.select("path"), "path", "left_semi")
        files = written(kept_files.unionByName(changed), "files")
    if stored_symbols is not None:
        kept = stored_symbols.join(files.select("path"), "path", "left_semi").join(new, "path", "left_anti")
        symbols = made.unionByName(kept, allowMissingColumns=True).select(*made.columns)
        dropped = stored_symbols.select("id").join(symbols.select("id"), "id", "left_anti")
    imports = resolve_imports(parsed, files)
    edges = build_edges(parsed, symbols, imports, symbols.filter("kind = 'table'").select("id", "name"), repo)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    stats = n(sources, "files_seen").crossJoin(n(parsed.filter("parsed"), "files_indexed")).crossJoin(n(parsed.filter("not parsed"), "files_failed")).crossJoin(n(made, "symbols")).crossJoin(n(edges, "edges")).crossJoin(n(own, "services")).crossJoin(n(made.filter("role = 'api'"), "endpoints")).crossJoin(n(made.filter("role = 'test' and kind <> 'file'"), "tests"))  # one row each
    return {"files": files, "symbols": symbols, "edges": edges, "services": own, "dropped": dropped if dropped is not None else made.select("id").limit(0), "stats": stats}


def retire_leases(leases: DataFrame, dropped: DataFrame) -> DataFrame:
    """(id, agent, symbol_id, task) of active leases on symbols that are gone: they expire, whoever holds them."""
    return leases.filter("state = 'active'").join(dropped.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").select("id", "agent", "symbol_id", "task")

