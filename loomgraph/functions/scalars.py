"""Scalar functions of the model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of tool names that tell an assistant or a service from a person, and the words a goal's title is not searched for.
AI_TOOLS = ["claude", "cursor", "copilot", "gemini", "opencode", "codex", "windsurf", "aider", "cody", "continue", "zed"]
SERVICE_TOOLS = ["ci", "bot", "agent", "runner", "worker", "pipeline"]
STOPWORDS = ["the", "a", "an", "implement", "add", "support", "for", "and", "to", "of", "in", "on", "with", "build", "create", "make", "new"]


def handle(path: Column, kind: Column, name: Column, fqn: Column) -> Column:
    """path of a file, service:name of a service, else path:fqn."""
    return F.when(kind == "file", path).when(kind == "service", F.concat(F.lit("service:"), name)).otherwise(F.concat_ws(":", path, fqn))


def stored_handle(path: Column, kind: Column, fqn: Column) -> Column:
    """As in leases and requests: no case for services."""
    return F.when(kind == "file", path).otherwise(F.concat_ws(":", path, fqn))


def secs_left(expires: Column, now: int | Column) -> Column:
    """Floors: -1 ms is -1 s."""
    return F.floor((expires - now) / 1000).cast("long")


def age_secs(since: Column, now: int | Column) -> Column:
    """Truncates toward zero."""
    return ((F.lit(now) - since) / 1000).cast("long")


def human_secs(secs: Column) -> Column:
    short = F.concat(secs.cast("string"), F.lit("s"))
    return F.when(secs < 60, short).otherwise(F.concat(F.floor(secs / 60).cast("string"), F.lit("m "), (secs % 60).cast("string"), F.lit("s")))


def slug(text: Column) -> Column:
    dashed = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.trim(F.substring(dashed, 1, 32), F.lit("-"))


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def leaf(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def top_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit(""))


def is_under(path: Column, dir_: Column) -> Column:
    return (dir_ == "") | (path == dir_) | path.startswith(F.concat(dir_, F.lit("/")))


def normalize_path(path: Column) -> Column:
    """Resolves . and ..; .. at the root is dropped."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, p: F.when((p == "") | (p == "."), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))),
    )
    return F.array_join(parts, "/")


def symbol_id(repo: Column, path: Column, kind: Column, fqn: Column, disambiguator: Column) -> Column:
    return F.concat(F.lit("s_"), F.substring(F.sha2(F.concat_ws("\u0000", repo, path, kind, fqn, disambiguator.cast("string")), 256), 1, 16))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def route(role: Column, meta: Column) -> Column:
    """METHOD path of an endpoint."""
    return F.when(role == "api", F.concat_ws(" ", F.get_json_object(meta, "$.method"), F.get_json_object(meta, "$.path")))


def worker_type(tool: Column, kind: Column, transport: Column) -> Column:
    """An editor belongs to a person; else the tool's name decides, without one the kind; nobody known is a person."""
    k = F.lower(kind)
    seen = F.concat_ws(" ", F.lower(F.coalesce(tool, kind)), k)
    return F.when(transport == "ide", "human").when(k.isin("human", "person", "dev"), "human").when(seen.rlike("|".join(AI_TOOLS)), "ai").when(seen.rlike("|".join(SERVICE_TOOLS)), "service").otherwise("human")


def keywords(text: Column) -> Column:
    """Lower-cased words of three bytes or more without stopwords; behind each, the same without a final es or else s."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: (F.octet_length(w) >= 3) & ~w.isin(STOPWORDS))
    forms = F.transform(words, lambda w: F.when(w.endswith("s"), F.array(w, F.regexp_replace(w, "(?:es|s)$", ""))).otherwise(F.array(w)))
    return F.array_distinct(F.flatten(forms))


def is_test_path(path: Column) -> Column:
    """By the folder (tests, test, __tests__) or the name of the file."""
    p = F.lower(path)
    folder = p.rlike("(^|/)tests?/") | p.contains("/__tests__/")
    name = F.regexp_extract(p, "([^/]*)$", 1)
    return folder | name.startswith("test_") | name.rlike(r"(_test\.(py|go|rs)|test\.java|tests\.cs)$") | name.contains(".test.") | name.contains(".spec.")


def normalize_ident(name: Column) -> Column:
    """The last part of a qualified name without quotes, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(name, r"([^.]*)$", 1), r"^[\s\"`\[\]]+|[\s\"`\[\]]+$", ""))
