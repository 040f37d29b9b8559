"""Personal data by weak supervision.

Fixed patterns give the base spans, which always stay. Wider patterns give candidates; labelers (shapes, word
lists, context) vote on each or abstain; expectation-maximisation over the counts of all vote patterns of the corpus
estimates how reliable each labeler is; and a logistic span classifier, fitted to the resulting probabilities on the
counts of feature patterns, decides. Vote and feature patterns are bit masks, so what is counted is bounded by the
number of labelers and features, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import strings, written

BASE_KINDS = ("email", "ip", "card", "phone")
# What the classifier may add, in the order they are listed after the base kinds.
ADDED_KINDS = ("secret", "iban", "national_id", "account", "user")
KINDS = BASE_KINDS + ADDED_KINDS

# The lookbehinds don't change the leftmost matches; they keep the search linear in long runs.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = re.compile(rf"{_LOCAL}+@{_HOST}+(\.{_HOST}+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches hold no white space, so only the stretches around an at sign are searched."""
    at, done = text.find("@"), 0
    while at >= 0:
        # The run of local characters before the sign, and all after it up to a character no match can hold.
        start = at
        while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans in the order kind, start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# Candidates: kind -> pattern; the first group is the span.
CANDIDATES = {
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])((?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9+/_-]{16,}+={0,2})(?![A-Za-z0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "national_id": re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    "account": re.compile(r"(?<![0-9A-Za-z.,+-])([0-9]{8,20})(?![0-9A-Za-z])"),
    "user": re.compile(r"(?<![A-Za-z0-9._%+@-])(@[A-Za-z_][A-Za-z0-9_]{2,30})(?![A-Za-z0-9_@])"),
}
# Words, in any of the corpus' languages, that name the datum which follows.
GAZETTEER = {
    "secret": {"token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "bearer", "credential",
               "credentials", "access_key", "secret_key", "passwort", "contraseña", "motdepasse", "clave", "auth"},
    "iban": {"iban", "konto", "kontonummer", "cuenta", "compte", "bank"},
    "national_id": {"ssn", "social", "passport", "id", "dni", "nif", "ausweis", "personalausweis", "insee"},
    "account": {"account", "acct", "konto", "kontonummer", "compte", "cuenta", "kundennummer", "customer", "number",
                "nummer", "número", "passport", "phone", "tel", "telefon", "mobile", "routing"},
    "user": {"user", "username", "handle", "twitter", "telegram", "instagram", "login", "usuario", "benutzer"},
}
# Words that name harmless numbers.
HARMLESS = {"version", "revision", "isbn", "issn", "commit", "sha", "sha1", "sha256", "md5", "hash", "build", "year", "page",
            "checksum", "digest", "license", "licence", "rfc", "line", "size", "bytes"}
_WORDS_BEFORE = re.compile(r"[\w]+")
_ASSIGNED = re.compile(r"[=:]\s*[\"']?$")

# Labelers: name -> vote of a candidate's facts: 1 personal, 0 not, None abstains.
LABELERS = {
    "shape": lambda f: 1 if f["shape"] else (0 if f["weak"] else None),
    "gazetteer": lambda f: 1 if f["named"] else None,
    "assigned": lambda f: 1 if f["assigned"] else None,
    "quoted": lambda f: 1 if f["quoted"] and f["assigned"] else None,
    "harmless": lambda f: 0 if f["harmless"] else None,
    "word_like": lambda f: 0 if f["word_like"] else None,
    "mixed": lambda f: 1 if f["mixed"] else (0 if not f["assigned"] and not f["named"] else None),
}
FEATURES = ("shape", "weak", "named", "assigned", "quoted", "harmless", "word_like", "mixed", "line_start", "in_path")


def _iban(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def facts(kind: str, value: str, before: str, after: str) -> dict[str, bool]:
    """What labelers and the classifier look at: the span, 48 characters before and 8 after it, on its own line."""
    left = before.rpartition("\n")[2]
    words = [w.lower() for w in _WORDS_BEFORE.findall(left)[-3:]]
    digits = sum(c.isdigit() for c in value)
    letters = len(value) - digits
    hexadecimal = len(value) >= 16 and all(c in "0123456789abcdefABCDEF" for c in value)
    shape = {
        "secret": hexadecimal and digits >= 4 and len(value) >= 20 or digits >= 4 and letters >= 6 and any(c.isupper() for c in value) and any(c.islower() for c in value),
        "iban": kind == "iban" and _iban(value),
        "national_id": value[:3] not in ("000", "666") and value[:1] != "9",
        "account": 9 <= digits <= 18 and len(set(value)) > 3,
        "user": any(c.isdigit() or c == "_" for c in value),
    }[kind]
    return {
        "shape": bool(shape), "weak": not shape, "named": any(w in GAZETTEER[kind] for w in words),
        "assigned": bool(_ASSIGNED.search(left)), "quoted": left[-1:] in ("'", '"') and after[:1] == left[-1:],
        "harmless": any(w in HARMLESS for w in words), "word_like": digits * 5 < len(value) and not hexadecimal,
        "mixed": digits >= 4 and letters >= 4, "line_start": not left.strip(), "in_path": "/" in value or left[-1:] in ("/", "-", "_"),
    }


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, int, int]]:
    """(kind, start, end, votes, features) of spans that are not within a base span; votes has two bits for each labeler."""
    held = sorted((a, b) for _, a, b in taken)
    for kind, pattern in CANDIDATES.items():
        if kind == "user" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1)
            if any(x <= a and b <= y for x, y in held):
                continue
            f = facts(kind, m[1], text[max(0, a - 48):a], text[b:b + 8])
            votes = 0
            for i, vote in enumerate(LABELERS.values()):
                v = vote(f)
                votes |= (0 if v is None else v + 1) << 2 * i
            yield kind, a, b, votes, sum(f[x] << i for i, x in enumerate(FEATURES))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, found) per row: base spans, and candidate spans with their vote and feature masks."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    wide = pa.struct([*span, pa.field("votes", pa.int64()), pa.field("features", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for text in strings(batch.column(1)):
                spans = base_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
                more = candidates(text, spans) if _DIGIT.search(text) or "@" in text else ()
                found.append([dict(zip(("kind", "start", "end", "votes", "features"), c)) for c in more])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(wide))], ["id", "base", "found"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, base array<struct<kind string, start long, end long>>, "
             "found array<struct<kind string, start long, end long, votes long, features long>>")


@dataclass(frozen=True)
class SpanClassifier:
    reliability: dict[str, tuple[float, float]]  # labeler -> P(votes 1 | personal, voted), P(votes 0 | not, voted)
    weights: np.ndarray  # of FEATURES, then a constant for each added kind
    bar: float = 0.5

    def accepts(self, kind: str, features: int) -> bool:
        x = [features >> i & 1 for i in range(len(FEATURES))] + [k == kind for k in ADDED_KINDS]
        return 1 / (1 + np.exp(-float(np.dot(self.weights, x)))) > self.bar


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each pattern, sensitivity, specificity of each labeler); votes are 0 none, 1 against, 2 for.

    Labelers that don't vote tell nothing. Beta priors of 8 right to 2 wrong votes keep a labeler that hardly ever votes
    near its prior and the two classes from changing places; the share of personal spans has the prior 1 to 1.
    """
    sensitivity = np.full(votes.shape[1], 0.8)
    specificity = np.full(votes.shape[1], 0.8)
    share = 0.5
    p = np.full(len(votes), 0.5)
    for _ in range(rounds):
        score = np.full(len(votes), np.log(share / (1 - share)))
        for j in range(votes.shape[1]):
            score += np.where(votes[:, j] == 2, np.log(sensitivity[j] / (1 - specificity[j])),
                              np.where(votes[:, j] == 1, np.log((1 - sensitivity[j]) / specificity[j]), 0.0))
        p = 1 / (1 + np.exp(-score))
        share = (1 + (p * counts).sum()) / (2 + counts.sum())
        for j in range(votes.shape[1]):
            yes, no = votes[:, j] == 2, votes[:, j] == 1
            good, bad = p * counts, (1 - p) * counts
            sensitivity[j] = (8 + good[yes].sum()) / (10 + good[yes | no].sum())
            specificity[j] = (8 + bad[no].sum()) / (10 + bad[yes | no].sum())
    return p, sensitivity, specificity


def fit(scanned: DataFrame, rounds: int = 300, rate: float = 0.5) -> SpanClassifier:
    """Label model and classifier from the counts of all candidates by (kind, votes, features)."""
    rows = (scanned.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.features")
            .agg(F.count("*").alias("n")).orderBy("kind", "votes", "features").collect())
    names = list(LABELERS)
    start = np.array([1.0, -1, 2, 1, 1, -2, -2, 1, 0, -1] + [-1.0] * len(ADDED_KINDS))
    if not rows:
        return SpanClassifier({n: (0.8, 0.8) for n in names}, start)
    votes = np.array([[r["votes"] >> 2 * j & 3 for j in range(len(names))] for r in rows])
    n = np.array([r["n"] for r in rows], float)
    p, right, not_wrong = expectation_maximisation(votes, n)
    x = np.array([[r["features"] >> i & 1 for i in range(len(FEATURES))] + [k == r["kind"] for k in ADDED_KINDS] for r in rows], float)
    w, share = start.copy(), n / n.sum()
    for _ in range(rounds):
        wrong = 1 / (1 + np.exp(-(x @ w))) - p
        w -= rate * (x.T @ (wrong * share) + 0.0005 * (w - start))
    return SpanClassifier(dict(zip(names, zip(right.tolist(), not_wrong.tolist()))), w)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) per row: base spans and all spans, as arrays of (kind, start, end) in code points, end exclusive,
    ordered by kind as in ``KINDS`` and then start.

    A null text is empty and has none. Repeated rows stay and count each in the label model. Other columns are not read.
    The scan is written once; the label model reads counts of it.
    """
    scanned = written(scan(docs, id_col, text_col), "spans")
    model = fit(scanned)
    # The verdict depends on kind and features only: a literal map of all that occur would grow, so it is computed.
    w = model.weights.tolist()

    def score(c: Column) -> Column:
        parts = [F.when(F.shiftrightunsigned(c["features"], i).bitwiseAND(F.lit(1)) == 1, w[i]).otherwise(0.0) for i in range(len(FEATURES))]
        parts += [F.when(c["kind"] == k, w[len(FEATURES) + i]).otherwise(0.0) for i, k in enumerate(ADDED_KINDS)]
        return sum(parts[1:], parts[0])

    order = F.array(*[F.lit(k) for k in KINDS])
    more = F.transform(F.filter("found", lambda c: score(c) > float(np.log(model.bar / (1 - model.bar)))), lambda c: F.struct(
        F.array_position(order, c["kind"]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    base = F.transform("base", lambda c: F.struct(
        F.array_position(order, c["kind"]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    spans = F.transform(F.sort_array(F.concat(base, more)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return scanned.select("id", "base", spans.alias("spans"))


def joined(spans) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; where spans overlap, they are one, named by the first."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redactor(model: SpanClassifier) -> Callable[[Column], Column]:
    """Column function: a text without its personal data; null stays null."""

    @F.arrow_udf("string")
    def redacted(column: pa.Array) -> pa.Array:
        out = []
        for text in column.to_pylist():
            spans = base_spans(text or "")
            spans += [c[:3] for c in candidates(text or "", spans) if model.accepts(c[0], c[4])]
            out.append(redact(text, spans))
        return pa.array(out, pa.string())

    return redacted
