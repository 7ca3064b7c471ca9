"""PII by bootstrapped contextual extraction (operator 8).

Candidates are runs of neighbouring words that hold a digit or an '@', and what
follows a key with '=' or ':' on its line (without a digit it has only the
patterns of its key).  A
candidate has an instance (its text) and lexical patterns: its shape (letters,
digits and punctuation as classes with lengths), its shape behind the word
before it, its shape behind a key such as ``password=``, and, from
``MIN_CONTEXT_LENGTH`` letters and digits on, that word or key with nothing of
the value but whether it holds letters, so that belief passes on to new shapes.
Seeds are the instances that a strict validator accepts.  Spark then scores the graph of
patterns and instances in turn: a pattern's confidence is the share of its
instances' belief, discounted by its support; an instance's belief is what its
best patterns give it (noisy or).  Patterns above ``min_confidence`` discover
identifiers that no validator knows, and the next round scores with those.

Scale.  One narrow scan finds the candidates (a fraction of a percent of the
text), all later steps are partial aggregations on them.  What applies to the
documents is the table of accepted patterns; it is broadcast while it has at
most ``MAX_BROADCAST_PATTERNS`` rows and otherwise spans are joined to the
documents by id.

Defined cases: NULL or empty texts have no finding and stay as they are; very
long texts are scanned whole; repeated rows are found each; a NULL id is carried
along; of kinds equally well founded the last in the alphabet is given; without
any seed nothing is found; other columns are kept by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import kernels as K
from quern.llm.common import col, free_name, small_batches
from quern.session import cut

ROUNDS = 3
MIN_CONFIDENCE = 0.6
MIN_SUPPORT = 3
MIN_BELIEF = 0.5
MIN_CONTEXT_LENGTH = 4
MAX_BROADCAST_PATTERNS = 200_000

_IS_MARK = np.zeros(256, dtype=bool)
_IS_MARK[48:58] = True
_IS_MARK[64] = True
_OPEN, _CLOSE = "\"'([{<`", "\"')]}>`,;:!?.*#$%&|"
NOT = "-"  # a validator knows the form and refutes the value
_KEY = re.compile(r"([A-Za-z][A-Za-z_\-]{1,30})\s*[=:]\s*[\"']?$")
_GLUED = re.compile(r"^([A-Za-z][A-Za-z_\-]{1,30})([=:])[\"']?(.+)$")
_EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}")
_IP = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")
_PHONE = re.compile(r"\+?1?[ .\-]?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\+\d{1,3}(?:[ .\-]?\d{2,4}){3,4}")
_AWS = re.compile(r"A(?:KI|SI)A[A-Z0-9]{16}")
_SECRET_KEY = re.compile(r"(?:pass(?:word|wd)?|pwd|secret|api_?key|auth|token)", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")
_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def seed_kind(value: str, key: str) -> str:
    """Kind of a value that a strict validator accepts, NOT where a check digit or range refutes it, else ''."""
    if _EMAIL.fullmatch(value):
        return "email"
    if _IP.fullmatch(value):
        return "ip"
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", value):
        return NOT
    if _SSN.fullmatch(value):
        return "national_id"
    if _PHONE.fullmatch(value):
        return "phone"
    if _AWS.fullmatch(value):
        return "secret"
    bare = re.sub(r"[ \-]", "", value)
    if 13 <= len(bare) <= 19 and bare.isascii() and bare.isdigit():
        return "card" if luhn(bare) else NOT
    if _IBAN.fullmatch(bare) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
        return "iban"
    if key and _SECRET_KEY.fullmatch(key) and len(value) >= 8:
        return "secret"
    return ""


def shape(value: str) -> str:
    """Classes of a value: hexadecimal, capitals with digits and mixed runs as one class with length, the rest by runs."""

    def one(m: re.Match) -> str:
        t = m.group()
        if t.isdigit():
            return f"9{len(t)}" if len(t) < 20 else "9+"
        if any(c.isdigit() for c in t):
            if re.fullmatch(r"[0-9a-f]+", t) and len(t) >= 8:
                return f"h{len(t)}"
            return (f"U{len(t)}" if t.isupper() else f"x{len(t)}") if len(t) >= 8 else "x"
        return "a"

    return re.sub(r"\w+", one, value)


def _tokens(text: str, spans: list[tuple[int, int, bool]]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, value, key) of the candidates; a span that a validator knows is taken as it is."""
    for start, end, known in spans:
        before = text[max(0, start - 40) : start]
        if known:
            named = _KEY.search(before)
            yield start, end, text[start:end], named.group(1) if named else ""
            continue
        while end - start > 2 and text[start] == "(" and text[end - 1] == ")":
            start, end = start + 1, end - 1
        while start < end and text[start] in _OPEN and not (text[start] == "(" and ")" in text[start:end]):
            start += 1
        while end > start and text[end - 1] in _CLOSE and not (text[end - 1] == ")" and "(" in text[start:end]):
            end -= 1
        if start == end:
            continue
        key = ""
        glued = _GLUED.match(text[start:end])
        if glued and not glued.group(3).startswith("//"):
            key, start = glued.group(1), start + glued.start(3)
            while end > start and text[end - 1] in _CLOSE:
                end -= 1
        elif named := _KEY.search(before):
            key = named.group(1)
        value = text[start:end]
        if value:
            yield start, end, value, key


_WHOLE = re.compile(r"\S+")
_INSIDE = [
    re.compile(rf"(?<![\w.%+\-])(?:{_EMAIL.pattern})(?![\w])"),
    re.compile(rf"(?<![\w.])(?:{_IP.pattern})(?!\w|\.\d)"),
    re.compile(rf"(?<![\w\-])(?:{_SSN.pattern})(?![\w\-])"),
    re.compile(rf"(?<![\w+])(?=[+1(])(?:{_PHONE.pattern})(?!\w)"),
    re.compile(rf"(?<!\w)(?:{_AWS.pattern})(?!\w)"),
]
_CARD = re.compile(r"(?<![\w+.\-])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ \-])\d{6}\2\d{4,5})(?![\w])")
_SPACED_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ \-]?[A-Z0-9]){11,30}")


def _valid(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Values inside text[start:end] that a validator knows, the longest first where they meet."""
    found = [m.span() for form in _INSIDE for m in form.finditer(text, start, end)]
    for m in _CARD.finditer(text, start, end):
        a, b = m.span()
        short = text[a : b - 4]  # of 4-4-4-4-3 the last group may be another number
        found.append((a, b - 4) if m.group(1) and b - a == 23 and seed_kind(text[a:b], "") != "card" and seed_kind(short, "") == "card" else (a, b))
    for m in _SPACED_IBAN.finditer(text, start, min(len(text), end + 44)):
        a, b = m.span()
        if a < end:
            found += next(([(a, e)] for e in range(b, a + 14, -1) if not text[e : e + 1].isalnum() and seed_kind(text[a:e], "") == "iban"), [])
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0] - x[1], x)):
        if all(b <= c or a >= d for c, d in out):
            out.append((a, b))
    return sorted(out)


def _split(text: str, start: int, end: int) -> list[tuple[int, int, bool]]:
    """A run of marked words as the values that validators know inside it, and word by word what is left."""
    parts = [(start + m.start(), start + m.end()) for m in _WHOLE.finditer(text[start:end])]
    secret = [(a, b) for a, b in parts if (glued := _GLUED.match(text[a:b].lstrip(_OPEN))) and _SECRET_KEY.fullmatch(glued.group(1))]
    known = [x for x in _valid(text, start, end) if all(x[1] <= a or x[0] >= b for a, b in secret)]
    out = [(a, b, True) for a, b in known]
    for a, b in parts:
        at = a
        for c, d in [*(x for x in known if x[0] < b and x[1] > a), (b, b)]:
            if c > at and ((at, c) == (a, b) or re.search(r"[\d@]", text[at:c])):
                out.append((at, c, False))
            at = max(at, d)
    return sorted(out)


def candidates(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, str, str, list[str]]]:
    """(start, end, value, key, seed kind, patterns), positions in characters."""
    done = 0
    for a, b in runs:
        if b <= done:  # inside an identifier that went on behind its run
            continue
        for start, end, value, key in _tokens(text, _split(text, max(a, done), b)):
            done = max(done, end)
            form = shape(value)
            left = re.findall(r"\S+", text[max(0, start - 60) : start])
            word = left[-1].lower()[-24:] if left else "^"
            plain = not re.search(r"[\d@]", value)
            if plain and not key:
                continue
            marks = [] if plain else [f"s {form}", f"w {word} {form}"]
            if key:
                marks.append(f"k {key.lower()} {form}")
            if sum(c.isalnum() for c in value) >= MIN_CONTEXT_LENGTH:
                coarse = "m" if any(c.isalpha() for c in value) else "n"
                marks += [f"c {word} {coarse}"] * (word != "^" and not plain) + [f"d {key.lower()} {coarse}"] * bool(key)
            yield start, end, value, key, seed_kind(value, key), marks


def _marked_runs(column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], str]]:
    """(row, runs, text) of the rows with a marked word: a digit, '@' or a key's sign in it, or a sign before it; runs are (start, end) in characters."""
    data, off = K.utf8_view(column)
    for lo, hi in K.chunks(off):
        part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        start, end, row = K.words(part, o, ~K.IS_SPACE)
        if not len(start):
            continue
        marks = np.concatenate(([0], np.cumsum(_IS_MARK[part])))
        sign = (part == 61) | (part == 58)
        signs, lines = (np.concatenate(([0], np.cumsum(x))) for x in (sign, part == 10))
        live = (marks[end] > marks[start]) | (signs[end - 1] > signs[start])  # the last sign has its value in the next word
        live[1:] |= sign[end[:-1] - 1] & (row[1:] == row[:-1]) & (lines[start[1:]] == lines[end[:-1]])
        hot = np.flatnonzero(live)
        if not len(hot):
            continue
        for r in np.unique(row[hot]):
            mine = hot[row[hot] == r] if len(hot) < 2000 else hot[np.searchsorted(row[hot], r) : np.searchsorted(row[hot], r, side="right")]
            raw = part[o[r] : o[r + 1]].tobytes()
            text = raw.decode("utf-8", "replace")
            ascii_only = len(text) == len(raw)
            runs: list[list[int]] = []
            prev = -2
            for w in mine.tolist():
                s, e = int(start[w] - o[r]), int(end[w] - o[r])
                if w == prev + 1 and b"\n" not in raw[runs[-1][1] : s]:
                    runs[-1][1] = e
                else:
                    runs.append([s, e])
                prev = w
            if ascii_only:
                yield lo + int(r), [(s, e) for s, e in runs], text
            else:
                edge, chars, out = 0, 0, []
                for s, e in runs:
                    chars += len(raw[edge:s].decode("utf-8", "replace"))
                    n = len(raw[s:e].decode("utf-8", "replace"))
                    out.append((chars, chars + n))
                    chars, edge = chars + n, e
                yield lo + int(r), out, text


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for r, runs, text in _marked_runs(batch.column(1)):
            for start, end, value, key, seed, marks in candidates(text, runs):
                rows.append((r, start, end, value, key, seed, marks))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.list_(pa.string()))],
            ["doc_id", "start", "end", "value", "key", "seed", "patterns"],
        )


def find_candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, value, key, seed, patterns); positions in characters, ``end`` exclusive."""
    own = small_batches(docs).select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text")).where("text RLIKE '[0-9@=:]'")
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_extract, f"doc_id {kind}, start long, end long, value string, key string, seed string, patterns array<string>")


def bootstrap(found: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT, min_belief: float = MIN_BELIEF) -> DataFrame:
    """(pattern, kind, confidence, support) of the accepted patterns.

    Support counts distinct instances, so a value copied a thousand times is one.
    """
    graph = cut(found.select(F.sha2("value", 256).alias("instance"), "seed", F.explode("patterns").alias("pattern")).groupBy("instance", "pattern").agg(F.max("seed").alias("seed")))
    kinds = graph.where("seed NOT IN ('', '-')").groupBy("pattern", "seed").agg(F.count("*").alias("n")).groupBy("pattern").agg(F.max_by("seed", F.struct("n", "seed")).alias("kind"))
    belief = graph.groupBy("instance").agg(F.max(F.when(F.col("seed").isin("", NOT), 0.0).otherwise(1.0)).alias("belief"))
    names, scores = kinds, None
    for step in range(rounds):
        scored = graph.join(belief, "instance")
        scores = scored.groupBy("pattern").agg((F.sum("belief") / (F.count("*") + F.lit(0.5))).alias("confidence"), F.count("*").alias("support"))
        scores = cut(scores.where((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support)).join(names, "pattern"))
        if step == rounds - 1:
            break
        through = graph.join(scores, "pattern", "left").groupBy("instance").agg(
            F.max(F.when(F.col("seed") == NOT, -1.0).when(F.col("seed") == "", 0.0).otherwise(1.0)).alias("seeded"),
            (1 - F.exp(F.sum(F.ln(F.greatest(1 - F.coalesce("confidence", F.lit(0.0)), F.lit(1e-9)))))).alias("given"),
            F.max_by("kind", F.struct("confidence", "kind")).alias("kind"),
        )
        through = cut(through)
        belief = through.select("instance", F.when(F.col("seeded") > 0, 1.0).when(F.col("seeded") < 0, 0.0).when(F.col("given") >= min_belief, F.col("given")).otherwise(0.0).alias("belief"))
        learned = graph.join(through.where((F.col("given") >= min_belief) & F.col("kind").isNotNull() & (F.col("seeded") >= 0)).select("instance", "kind"), "instance").groupBy("pattern", "kind").count()
        names = learned.groupBy("pattern").agg(F.max_by("kind", F.struct("count", "kind")).alias("kind"))
        names = names.join(kinds.withColumnRenamed("kind", "own"), "pattern", "full").select("pattern", F.coalesce("own", "kind").alias("kind"))
    return scores


def judge(found: DataFrame, patterns: DataFrame, min_belief: float = MIN_BELIEF) -> DataFrame:
    """(doc_id, start, end, kind, how, belief) of the candidates that are seeds or that accepted patterns cover."""
    one = found.withColumn("_row", F.monotonically_increasing_id())
    one = cut(one)
    given = one.select("_row", F.explode("patterns").alias("pattern")).join(patterns, "pattern").groupBy("_row").agg((1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("given"), F.max_by("kind", F.struct("confidence", "kind")).alias("learned"))
    all_ = one.join(given, "_row", "left")
    return all_.where((F.col("seed") != NOT) & ((F.col("seed") != "") | (F.col("given") >= min_belief))).select(
        "doc_id", "start", "end",
        F.when(F.col("seed") != "", F.col("seed")).otherwise(F.col("learned")).alias("kind"),
        F.when(F.col("seed") != "", "seed").otherwise("pattern").alias("how"),
        F.round(F.when(F.col("seed") != "", 1.0).otherwise(F.col("given")), 4).alias("belief"),
        F.sha2("value", 256).alias("value_hash"),
    )


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Every identifier of every document: one row each, without its text."""
    found = cut(find_candidates(docs, doc_id, text))
    return judge(found, bootstrap(found, **settings))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: str = "n_chars", min_belief: float = MIN_BELIEF, **settings) -> DataFrame:
    """``docs`` with every identifier replaced by its kind in brackets, and ``size`` (if there) recounted."""
    patterns = bootstrap(find_candidates(docs, doc_id, text), min_belief=min_belief, **settings)
    table: dict[str, tuple[float, str]] | None = None
    few = patterns.limit(MAX_BROADCAST_PATTERNS + 1).count() <= MAX_BROADCAST_PATTERNS
    if not few:
        return _redact_by_join(docs, patterns, doc_id, text, size, min_belief)
    table = {r["pattern"]: (float(r["confidence"]), r["kind"]) for r in patterns.select("pattern", "confidence", "kind").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(table)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            column, changed = batch.column(at), {}
            for r, runs, body in _marked_runs(column):
                out, edge = [], 0
                for start, end, _, _, seed, marks in candidates(body, runs):
                    hits = [known[m] for m in marks if m in known]
                    rest = 1.0
                    for confidence, _ in hits:
                        rest *= max(1 - confidence, 1e-9)
                    if seed != NOT and (seed or (hits and 1 - rest >= min_belief)):
                        out += [body[edge:start], f"[{(seed or max(hits)[1]).upper()}]"]
                        edge = end
                if out:
                    changed[r] = "".join([*out, body[edge:]])
            if changed:
                values = column.to_pylist()
                for r, value in changed.items():
                    values[r] = value
                column = pa.array(values, column.type)
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return _resize(out, docs, text, size)


def _resize(out: DataFrame, docs: DataFrame, text: str, size: str) -> DataFrame:
    if size not in docs.columns:
        return out
    kind = docs.schema[size].dataType
    return out.select(*(F.char_length(col(text)).cast(kind).alias(size) if c == size else col(c) for c in docs.columns))


def _redact_by_join(docs: DataFrame, patterns: DataFrame, doc_id: str, text: str, size: str, min_belief: float) -> DataFrame:
    """The same with the spans joined to the documents, for pattern tables too large to broadcast."""
    row = free_name(docs, "_row")
    spans = free_name(docs, "_spans", (row,))
    own = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    hits = judge(find_candidates(own, row, text), patterns, min_belief)
    lists = hits.groupBy(F.col("doc_id").alias(row)).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(spans))
    parts = F.aggregate(
        F.col(spans),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("edge")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring(col(text), (s["edge"] + 1).cast("int"), (x["start"] - s["edge"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"), x["end"].alias("edge")),
        lambda s: F.concat(s["out"], F.substring(col(text), (s["edge"] + 1).cast("int"), F.lit(2147483647))),
    )
    joined = own.join(lists, row, "left")
    out = joined.select(*(F.when(F.col(spans).isNotNull(), parts).otherwise(col(text)).alias(text) if c == text else col(c) for c in docs.columns))
    return _resize(out, docs, text, size)
