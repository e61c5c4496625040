"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are strings of known key formats, values assigned to names like `token`, and long mixed strings. The forest sees
their length, character classes and transitions, how improbable their letter pairs are in ordinary words, how much of them
dictionary words cover, the path, and the words before and behind. It is trained from labelled findings: rows of
(candidate, before, after, path, label); where none are given, `labelled_findings` makes a fixed set of them from
formats of keys on the one side and of digests, identifiers, placeholders and plain words on the other.

The letter pairs and the dictionary, the DICTIONARY most frequent words, are counted over all whole texts (a shuffle of
partial counts); every text is scanned whole, per document and without a shuffle.

Defined cases: null text has no candidates; an empty table gives an empty result; overlapping candidates: the one of the
earlier pattern stays; repeated rows give repeated findings; very long strings are candidates as a whole and described as a
whole; without any labelled finding nothing is known against a candidate, and each has score 0.5; equally frequent words
enter the dictionary in alphabetical order; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import byte_column, drop_table, id_text, materialize, ship

#: Kind and pattern of candidates; a group named `v` is the candidate, else the whole match.
PATTERNS = [
    ("private_key", rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    ("aws_access_key", rb"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", rb"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack_token", rb"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google_api_key", rb"\bAIza[0-9A-Za-z_-]{35}"),
    ("stripe_key", rb"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    ("jwt", rb"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("url_password", rb"(?<![a-z0-9+.-])[0-9+.-]*[a-z][a-z0-9+.-]*://[^\s/:@]+:(?P<v>[^\s/@]{3,})@"),
    ("assigned", rb"""(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|credential)s?["']?\s*(?:=|:|:=|=>)\s*["']?(?P<v>[^\s"'<>,;]{8,})"""),
    ("mixed", rb"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{24,}"),
]
COMPILED = [(kind, re.compile(p)) for kind, p in PATTERNS]
#: Every candidate holds one of these, which is quick to look for.
HINT = re.compile(rb"(?i)[A-Za-z0-9+/_=-]{16}|tok|sec|pas|pwd|key|cred|://|xox")
NEAR = 48
#: How many words the dictionary has at most, and how many bytes of a text are counted in one go.
DICTIONARY, PIECE = 20_000, 1 << 20
GOOD_WORDS = {"token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "credential", "credentials", "bearer", "private", "access", "login", "aws", "api"}
BAD_WORDS = {"example", "sample", "dummy", "test", "fake", "placeholder", "sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "uuid", "guid", "id", "integrity", "etag", "revision", "version", "http", "https", "www", "file", "path", "your", "xxxx", "changeme"}
FEATURES = "length entropy digits upper lower symbols changes hex repeats pairs dictionary good_before bad_near path_test path_config assigned quoted kind uuid".split()


def pair_index(data: bytes) -> np.ndarray:
    """Letter pairs of lower-cased text, others as one class, as numbers below 27 * 27."""
    a = np.frombuffer(data.lower(), np.uint8).astype(np.int64) - 97
    a[(a < 0) | (a > 25)] = 26
    return a[:-1] * 27 + a[1:]


class Language:
    """Letter-pair probabilities and words of ordinary text."""

    def __init__(self, counts: np.ndarray, words: set[bytes]):
        self.log = np.log((counts + 0.5) / (counts.reshape(27, 27).sum(1).repeat(27) + 0.5 * 27))
        self.words = words

    def pairs(self, v: bytes) -> float:
        return float(self.log[pair_index(v)].mean()) if len(v) > 1 else 0.0

    def coverage(self, v: bytes) -> float:
        """Share of letters in dictionary words of four letters or more, taken greedily from the left."""
        v, at, covered = v.lower(), 0, 0
        while at + 4 <= len(v):
            n = next((n for n in range(min(16, len(v) - at), 3, -1) if v[at : at + n] in self.words), 0)
            covered += n
            at += n or 1
        return covered / max(1, len(v))


KINDS = {kind: i for i, (kind, _) in enumerate(PATTERNS)}
UUID = re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z")


def features(v: bytes, kind: str, before: bytes, after: bytes, path: str, lang: Language) -> list[float]:
    n = len(v)
    a = np.frombuffer(v, np.uint8)
    counts = np.bincount(a)
    share = counts[counts > 0] / max(n, 1)
    digit, up, low = (a >= 48) & (a <= 57), (a >= 65) & (a <= 90), (a >= 97) & (a <= 122)
    kinds = digit + 2 * up + 3 * low
    near_before = re.findall(rb"[a-z0-9]+", before.lower())[-4:]
    near_after = re.findall(rb"[a-z0-9]+", after.lower())[:3]
    words = {w.decode() for w in near_before}
    own = {w.decode() for w in re.findall(rb"[a-z]{3,}", v.lower())}
    where = path.lower()
    return [
        n, float(-(share * np.log2(share)).sum()), digit.mean() if n else 0, up.mean() if n else 0, low.mean() if n else 0, 1 - (digit | up | low).mean() if n else 0,
        float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0, float(bool(re.fullmatch(rb"[0-9a-fA-F]+", v))), float(share.max(initial=0)),
        lang.pairs(v), lang.coverage(v), len(words & GOOD_WORDS), len((words | own | {w.decode() for w in near_after}) & BAD_WORDS),
        float(bool(re.search(r"test|example|sample|doc|fixture|mock", where))), float(bool(re.search(r"\.env|config|\.ya?ml|\.ini|\.pem|secret|deploy", where))),
        float(bool(re.search(rb"[=:]\s*[\"']?\Z", before))), float(before[-1:] in (b'"', b"'")), KINDS[kind], float(bool(UUID.match(v))),
    ]


def candidates(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order; earlier patterns go first where two overlap."""
    if not HINT.search(text):
        return []
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in COMPILED:
        for m in pattern.finditer(text):
            start, end = m.span("v") if "v" in pattern.groupindex else m.span()
            taken.append((start, end, kind))
    taken.sort(key=lambda t: KINDS[t[2]])
    kept: list[tuple[int, int, str]] = []
    starts: list[int] = []
    for start, end, kind in taken:
        i = bisect.bisect_left(starts, start)
        if (i and kept[i - 1][1] > start) or (i < len(kept) and kept[i][0] < end):
            continue
        starts.insert(i, start)
        kept.insert(i, (start, end, kind))
    return kept


class Forest:
    """Random forest of binary classification trees, by Gini impurity on bootstrap samples and random features."""

    def __init__(self, trees: int = 40, depth: int = 9, seed: int = 1):
        self.trees, self.depth, self.rng, self.roots = trees, depth, np.random.default_rng(seed), []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        for _ in range(self.trees):
            at = self.rng.integers(0, len(y), len(y))
            self.roots.append(self._grow(x[at], y[at], self.depth))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        share = float(y.mean()) if len(y) else 0.5
        if not depth or len(y) < 6 or share in (0.0, 1.0):
            return share
        best = (share * (1 - share) - 1e-9, -1, 0.0)
        for f in self.rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            left = np.cumsum(t)[cut - 1]
            pl, pr = left / cut, (t.sum() - left) / (len(t) - cut)
            gini = (cut * pl * (1 - pl) + (len(t) - cut) * pr * (1 - pr)) / len(t)
            i = int(gini.argmin())
            if gini[i] < best[0]:
                best = (float(gini[i]), int(f), float((v[cut[i] - 1] + v[cut[i]]) / 2))
        if best[1] < 0:
            return share
        on = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[on], y[on], depth - 1), self._grow(x[~on], y[~on], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))

        def walk(node, rows: np.ndarray) -> None:
            while not isinstance(node, float):
                on = x[rows, node[0]] <= node[1]
                walk(node[2], rows[on])
                rows, node = rows[~on], node[3]
            out[rows] += node

        for root in self.roots:
            walk(root, np.arange(len(x)))
        return out / max(1, len(self.roots))


def labelled_findings(words: list[bytes], n: int = 3000, seed: int = 7) -> list[tuple[bytes, bytes, bytes, str, int]]:
    """(candidate, before, after, path, label): keys of many formats, and what is taken for them."""
    rng = np.random.default_rng(seed)
    words = words or [b"some", b"plain", b"words"]
    alnum, hexa, base64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    text = lambda letters, a, b=None: "".join(rng.choice(list(letters), int(rng.integers(a, (b or a) + 1)))).encode()
    some = lambda k: b" ".join(words[int(rng.integers(len(words)))] for _ in range(k))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    names = (b"token", b"secret", b"password", b"api_key", b"access_key", b"auth_key")
    assign = lambda name: name + pick(b" = ", b"=", b": ", b":") + pick(b'"', b"'", b"", b'"')
    out = []
    for i in range(n):
        before, after, path = some(3) + b" ", pick(b'"', b"'", b"") + b" " + some(2), pick("", "src/app.py", "config/prod.yml", "deploy/.env", "src3", "notes.txt")
        if i % 2:
            made = pick("assigned", "assigned", "aws", "github", "slack", "google", "stripe", "jwt", "bare")
            if made == "assigned":
                v, before = pick(text(hexa, 32, 64), text(alnum, 20, 48), text(base64, 32, 64), text(alnum + "!@#%^*", 12, 24)), before + assign(pick(*names))
            elif made == "bare":
                v, before = text(alnum, 32, 44), before + pick(b"key ", b"bearer ", b"secret ")
            else:
                v = {"aws": b"AKIA" + text(string.ascii_uppercase + string.digits, 16), "github": b"ghp_" + text(alnum, 36), "slack": b"xoxb-" + text(string.digits, 10) + b"-" + text(alnum, 24), "google": b"AIza" + text(alnum, 35), "stripe": b"sk_live_" + text(alnum, 24), "jwt": b"eyJ" + text(alnum, 20) + b".eyJ" + text(alnum, 40) + b"." + text(alnum, 43)}[made]
                before += pick(b"", assign(pick(*names)))
            out.append((v, before, after, path, 1))
        else:
            made = pick("digest", "uuid", "placeholder", "words", "path", "assigned_words", "repeat", "example")
            path = pick(path, "docs/example.md", "tests/test_app.py")
            if made == "digest":
                v, before = text(hexa, pick(32, 40, 64)), before + pick(b"sha256 ", b"md5:", b"commit ", b"checksum = ", b"etag: ", b"integrity sha256-", b"digest ")
            elif made == "uuid":
                v, before = b"-".join(text(hexa, k) for k in (8, 4, 4, 4, 12)), before + pick(b"id ", b"uuid: ", b"")
            elif made == "placeholder":
                v, before = pick(b"your_token_goes_here", b"xxxxxxxxxxxxxxxxxxxx", b"changeme1234", b"<placeholder>", b"example_password", b"${SECRET_TOKEN}", b"INSERT_KEY_HERE_0000"), before + assign(pick(*names))
            elif made == "words":
                v = (b"-" if i % 4 else b"_").join(words[int(rng.integers(len(words)))] for _ in range(6)) + pick(b"-2", b"_10", b"1")
            elif made == "path":
                v = b"/".join(words[int(rng.integers(len(words)))] for _ in range(5)) + b"/v2"
            elif made == "assigned_words":
                v, before = b"".join(words[int(rng.integers(len(words)))] for _ in range(3)), before + assign(pick(*names))
            elif made == "repeat":
                v = text("ab01", 2, 3) * 12
            else:
                v, before = b"AKIA" + text(string.ascii_uppercase, 9) + b"EXAMPLE", b"for example " + before
            out.append((v, before, after, path, 0))
    return out


def kind_of(v: bytes, before: bytes) -> str:
    """The kind that a scan would give a labelled finding."""
    found = [kind for start, end, kind in candidates(before[-NEAR:] + v) if end == len(before[-NEAR:]) + len(v)]
    return found[0] if found else "mixed"


class Model:
    def __init__(self, lang: Language, findings: list[tuple[bytes, bytes, bytes, str, int]]):
        self.lang = lang
        x = np.array([features(v, kind_of(v, b), b[-NEAR:], a[:NEAR], p, lang) for v, b, a, p, _ in findings]).reshape(len(findings), len(FEATURES))
        self.forest = Forest().fit(x, np.array([f[4] for f in findings], float))

    def scores(self, rows: list[list[float]]) -> list[float]:
        return self.forest.predict(np.array(rows)).tolist() if rows else []


def _counted(batches: Iterator[pa.RecordBatch], most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Partial counts: of words (word, -1) and, at the end of a partition, of letter pairs (none, pair_index)."""
    pairs, words = np.zeros(27 * 27, np.int64), Counter()

    def out(names: list[str | None], numbers: list[int], counts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.array(counts, pa.int64())], ["word", "pair", "c"])

    def some() -> pa.RecordBatch:
        batch = out([w.decode() for w in words], [-1] * len(words), list(words.values()))
        words.clear()
        return batch

    for batch in batches:
        for text in byte_column(batch, "text"):
            for i in range(0, len(text) - 1, PIECE):
                pairs += np.bincount(pair_index(text[i : i + PIECE + 1]), minlength=27 * 27)
            words.update(w for w in re.findall(rb"[a-z]+", text.lower()) if 4 <= len(w) <= 16)
            if len(words) > most:
                yield some()
    yield some()
    seen = np.flatnonzero(pairs).tolist()
    yield out([None] * len(seen), seen, pairs[seen].tolist())


def least_count(words: DataFrame, most: int) -> int:
    """A count that at least `most` words reach, if there are so many, and not many more: counts go by eighths of a doubling."""
    step = F.floor(F.log2("c") * 8).cast("int")
    total, least = 0, 2
    for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect():
        total, least = total + r.n, r.least
        if total >= most:
            break
    return least


def fit_language(docs: DataFrame) -> Language:
    """Letter pairs and the DICTIONARY most frequent words of all whole texts, among those that occur twice."""
    ship(docs.sparkSession)
    parts = docs.filter("text is not null").select("text").mapInArrow(_counted, "word string, pair int, c long")
    counted = materialize(parts.groupBy("word", "pair").agg(F.sum("c").alias("c")), "words")
    pairs = np.zeros(27 * 27)
    for r in counted.filter("pair >= 0").collect():  # at most 27 * 27 rows
        pairs[r.pair] = r.c
    words = counted.filter("pair < 0 and c > 1").select("word", "c")
    frequent = words.filter(F.col("c") >= least_count(words, DICTIONARY)).orderBy(F.desc("c"), "word").limit(DICTIONARY)
    found = {r.word.encode() for r in frequent.collect()}
    drop_table(counted)
    return Language(pairs, found)


def scan_secrets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, findings: list[tuple[bytes, bytes, bytes, str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """A row for each candidate: doc_id, start_byte, end_byte, kind, value_sha256, score, is_secret. Secrets themselves aren't returned."""
    rows = id_text(df, id_col, text_col, (F.lit("") if path is None else F.coalesce(path.cast("string"), F.lit(""))).alias("path"))
    lang = fit_language(rows)
    model = Model(lang, labelled_findings(sorted(lang.words)) if findings is None else findings)
    shared = df.sparkSession.sparkContext.broadcast(model)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found, x = [], []
            for doc, text, where in zip(batch.column(0).to_pylist(), byte_column(batch, "text"), batch.column(2).to_pylist(), strict=True):
                for start, end, kind in candidates(text or b""):
                    v = text[start:end]
                    found.append((doc, start, end, kind, hashlib.sha256(v).hexdigest()))
                    x.append(features(v, kind, text[max(0, start - NEAR) : start], text[end : end + NEAR], where, m.lang))
            scores = m.scores(x)
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())], ["doc_id", "start_byte", "end_byte", "kind", "value_sha256", "score", "is_secret"])

    return rows.mapInArrow(run, "doc_id long, start_byte long, end_byte long, kind string, value_sha256 string, score double, is_secret boolean")
