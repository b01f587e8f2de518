"""Personal data by weak supervision.

Strong kinds (email, ip, card, phone) are found by fixed patterns and always
kept. Looser candidates get votes from labelers: form (regex and checksums), cues
(fixed words in five languages close before), names (a gazetteer that is learnt
from the corpus: what follows a title in NAMES_SEEN places or more, and whatever
the caller adds), context (marks around the candidate) and counter (words that
speak against it).

Votes over all documents are counted by pattern. For each kind,
expectation-maximisation estimates how often each labeler votes which way on true
and on false spans, and so each pattern's posterior. A logistic span classifier is
trained on these posteriors over a bounded sample of candidates. Its features are
the votes, but also the words around the candidate, its shape and its place in the
line, so it can tell apart candidates with the same votes. Its verdict adds a span
or not.

What reaches the driver is bounded at any size: the counts (kinds by patterns), a
sample of SAMPLE candidates in expectation, and NAMES_MOST names.

Defined cases: null texts are empty; without candidates nothing is added, nor of a
kind whose candidates got no vote for them; rows that repeat give the same spans
each; added spans never overlap base ones, and of candidates that overlap the
first counts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_texts, tidy, written

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "spelled_email", "national_id", "iban", "person", "birth_date")
RANK = {kind: i for i, kind in enumerate((*BASE, *ADDED))}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")

# Titles that stand before names; fixed values.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
_NAME = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'-]{1,30}"
#: The last word of a name after a title, for Java's regular expressions.
TITLED = rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(TITLES)})\.?\x20(?:{_NAME}\x20)?({_NAME})(?![\p{{L}}\p{{N}}_])"
#: Two capitalised words, of which the second must be in the gazetteer.
BARE = re.compile(rf"(?<!\w){_NAME}(?=\x20({_NAME})(?!\w))")

# Loose forms. All start at a rare character, so scanning is linear.
LOOSE = {
    "local_phone": re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", re.A),
    "spelled_email": re.compile(r"(?<=[A-Za-z0-9])(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)(?:[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)){1,3}[A-Za-z]{2,10}\b", re.A),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", re.A),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A),
    "person": re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.?\x20{_NAME}(?:\x20{_NAME})?(?!\w)"),
    "birth_date": re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9/-])", re.A),
}
# Cue words of the gazetteer labeler, by kind; fixed values.
CUES = {
    "local_phone": ("phone", "tel", "telefon", "téléphone", "teléfono", "mobile", "call", "fax", "whatsapp", "anruf"),
    "spelled_email": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel", "kontakt", "reach"),
    "national_id": ("ssn", "social", "security", "id", "dni", "ausweis", "insurance", "tax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer", "überweisung"),
    "person": ("name", "dear", "from", "signed", "sehr", "cher", "estimado", "contact", "patient"),
    "birth_date": ("born", "birth", "dob", "birthday", "geboren", "geburtstag", "né", "née", "nacido", "nacimiento"),
}
AGAINST = ("version", "v", "isbn", "order", "section", "chapter", "page", "invoice", "sku", "part")
WORD = re.compile(r"[^\W_]+")
LABELERS = ("form", "cues", "names", "context", "counter")
YES, NO, MUTE = 2, 0, 1
BEFORE, AFTER = 40, 24  # code points looked at before and after a candidate
NAMES_SEEN, NAMES_MOST = 3, 50_000  # places that a learnt name needs, and names kept (the most frequent)
SAMPLE = 20_000  # candidates that train the classifier, in expectation
FEATURES, SLOTS = 1024, 6 + len(LABELERS)  # weights, and features of a candidate
ROUNDS, STEPS, RATE, DECAY = 60, 300, 0.1, 1e-4  # of EM; of the classifier's training
WIDTH = 4 + SLOTS  # numbers of a candidate: start, rank, end, votes, features


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) of the strong kinds, leftmost and non-overlapping by kind."""
    out, reach, at = [], 0, t.find("@")
    while at >= 0:
        low = at
        while low > reach and t[low - 1] in _LOCAL:
            low -= 1
        m = _DOMAIN.match(t, at + 1) if low < at else None
        if m:
            out.append((low, 0, m.end()))
            reach = m.end()
        at = t.find("@", max(at + 1, reach))
    if not _DIGITS.search(t):
        return out
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(t):
        if m.end() - m.start() <= 37:
            d = _DIGITS.findall(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(t):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def luhn(digits: list[str]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def well_formed(kind: str, s: str) -> int:
    if kind == "iban":
        x = s.replace(" ", "")
        return YES if 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 else NO
    if kind == "national_id":
        return NO if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else YES
    if kind == "birth_date":
        p = [int(x) for x in re.split(r"[-./]", s)]
        y, a, b = (p[0], p[1], p[2]) if p[0] > 31 else (p[2], p[0], p[1])
        return YES if 1900 <= y <= 2025 and 1 <= min(a, b) <= 12 and max(a, b) <= 31 else NO
    if kind == "local_phone":
        d = "".join(_DIGITS.findall(s))
        return YES if d[0] not in "01" and d[3] not in "01" else NO
    if kind == "spelled_email":
        return YES if "[" in s or "(" in s else MUTE
    return YES if s.split()[0].rstrip(".") in TITLES else MUTE


def _found(t: str, names: frozenset[str]) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of all loose matches."""
    found = []
    digits = _DIGITS.search(t) is not None
    for kind, pattern in LOOSE.items():
        if not digits and kind not in ("spelled_email", "person") or kind == "spelled_email" and "dot" not in t:
            continue
        for m in pattern.finditer(t):
            low = m.start()
            if kind == "spelled_email":  # the match starts at the "at"; the name stands before it
                while low > 0 and m.start() - low < 64 and t[low - 1] in _LOCAL:
                    low -= 1
            found.append((low, RANK[kind], m.end(), kind))
    if names:
        found += [(m.start(), RANK["person"], m.end(1), "person") for m in BARE.finditer(t) if m[1] in names]
    return sorted(found)


def candidates(t: str, base: list[tuple[int, int, int]], names: frozenset[str] = frozenset()) -> list[tuple[int, ...]]:
    """(start, rank, end, votes, features ...) of the loose kinds that overlap no base span and no earlier candidate."""
    out, reach, taken = [], 0, iter([*base, (len(t) + 1, 0, len(t) + 1)])
    b = next(taken)
    for low, rank, high, kind in _found(t, names):
        while b[2] <= low:
            b = next(taken)
        if low < reach or b[0] < high:
            continue
        reach = high
        span, ahead, behind = t[low:high], t[max(0, low - BEFORE) : low], t[high : high + AFTER]
        words = [w.lower() for w in WORD.findall(ahead)]
        votes = (
            well_formed(kind, span),
            YES if any(w in CUES[kind] for w in words) else MUTE,
            YES if kind == "person" and span.rpartition(" ")[2] in names else MUTE,
            YES if ahead.rstrip()[-1:] in (":", "=", "(") else NO if ahead[-1:] in ("$", "#", "/", "_") or behind[:1] in ("%", "_") else MUTE,
            NO if any(w in AGAINST for w in words[-2:]) else MUTE,
        )
        out.append((low, rank, high, sum(v * 3**i for i, v in enumerate(votes)), *features(kind, votes, span, words, ahead, behind)))
    return out


def features(kind: str, votes: tuple[int, ...], span: str, words: list[str], ahead: str, behind: str) -> list[int]:
    """SLOTS feature numbers below FEATURES: each vote, the words around, the shape and the place."""
    after = WORD.search(behind)
    told = [f"{name}={v}" for name, v in zip(LABELERS, votes)]
    told += [f"before={''.join(words[-1:])}", f"before2={''.join(words[-2:-1])}", f"after={after[0].lower() if after else ''}"]
    told += [f"shape={re.sub('[0-9]+', '9', re.sub('[A-Z]+', 'A', re.sub('[^A-Z0-9 .,:/()+-]+', 'a', span)))}", f"edges={ahead[-1:]!r}{behind[:1]!r}", "kind"]
    return [zlib.crc32(f"{kind} {x}".encode("utf-8", "surrogatepass")) % FEATURES for x in told]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Aggregation:
    """Labeler reliabilities and posteriors of each kind by EM over vote counts."""

    def __init__(self, counts: list[tuple[int, int, int]], rounds: int = ROUNDS):
        """counts: (rank, votes, n)."""
        self.reliability: dict[int, np.ndarray] = {}  # by kind: labeler, false or true, vote
        self.prior: dict[int, float] = {}
        self.posterior: dict[tuple[int, int], float] = {}
        for kind in sorted({r for r, _, _ in counts}):
            votes, n = (np.array(x) for x in zip(*((v, n) for r, v, n in counts if r == kind)))
            vote = np.stack([votes // 3**i % 3 for i in range(len(LABELERS))], axis=1)
            p = self._of_kind(kind, vote, n, rounds) if (vote == YES).any() else np.zeros(len(n))
            self.posterior |= {(kind, int(v)): float(x) for v, x in zip(votes, p)}

    def _of_kind(self, kind: int, vote: np.ndarray, n: np.ndarray, rounds: int) -> np.ndarray:
        p = sigmoid((vote - 1).sum(axis=1).astype(float))  # the labelers' majority, to start from
        for _ in range(rounds):
            table = np.empty((len(LABELERS), 2, 3))
            for i in range(len(LABELERS)):
                for v in range(3):
                    at = vote[:, i] == v
                    table[i, 1, v], table[i, 0, v] = (n * p)[at].sum() + 1, (n * (1 - p))[at].sum() + 1
            # A labeler never speaks against its own meaning: YES is at least as likely on true spans, NO on false ones.
            table /= table.sum(axis=2, keepdims=True)
            table[:, 1, YES] = np.maximum(table[:, 1, YES], table[:, 0, YES])
            table[:, 0, NO] = np.maximum(table[:, 0, NO], table[:, 1, NO])
            table /= table.sum(axis=2, keepdims=True)
            prior = float(np.clip((n * p).sum() / n.sum(), 0.05, 0.95))
            p = sigmoid(np.log(prior / (1 - prior)) + sum(np.log(table[i, 1, vote[:, i]] / table[i, 0, vote[:, i]]) for i in range(len(LABELERS))))
        self.reliability[kind], self.prior[kind] = table, prior
        return p


def classifier(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Weights of a logistic model of posteriors p by rows of feature numbers x."""
    w, m, v = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    if not len(x):
        return w
    for step in range(1, STEPS + 1):
        off = (sigmoid(w[x].sum(axis=1)) - p) / len(x)
        grad = np.bincount(x.ravel(), np.repeat(off, x.shape[1]), FEATURES) + DECAY * w
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def learnt_names(docs: DataFrame) -> frozenset[str]:
    """The gazetteer: last words of names after titles, the NAMES_MOST most frequent of those seen NAMES_SEEN times."""
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(TITLED), F.lit(1))).alias("name"))
    often = found.groupBy("name").count().where(F.col("count") >= NAMES_SEEN).orderBy(F.desc("count"), "name").limit(NAMES_MOST)
    return frozenset(r["name"] for r in often.collect())


def scan(docs: DataFrame, names: frozenset[str] = frozenset()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row. names: a gazetteer of surnames to add
    to the learnt one; it is sent to executors, so the caller bounds it."""
    spark = for_texts(docs).sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = [*BASE, *ADDED]
    known = spark.sparkContext.broadcast(learnt_names(docs) | names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, loose = [], []
            for t in batch.column(1).to_pylist():
                base.append(base_spans(t or ""))
                loose.append(candidates(t or "", base[-1], known.value))
            flat = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[x for s in b for x in s] for b in base], flat), pa.array([[x for s in c for x in s] for c in loose], flat)], names=["doc_id", "base", "loose"])

    found = written(docs.select("doc_id", "text").mapInArrow(tidy(find), f"doc_id {id_type}, base array<int>, loose array<int>"))
    each = found.where(F.size("loose") > 0).select(F.xxhash64("doc_id").alias("h"), F.explode(F.expr(f"transform(sequence(0, size(loose) div {WIDTH} - 1), i -> slice(loose, {WIDTH} * i + 1, {WIDTH}))")).alias("c"))
    counts = each.groupBy(F.expr("c[1]").alias("rank"), F.expr("c[3]").alias("votes")).count().collect()  # at most kinds x 3 ** labelers rows
    em = Aggregation(sorted((r["rank"], r["votes"], r["count"]) for r in counts))
    rate = min(1_000_000, -(-1_000_000 * SAMPLE // max(1, sum(r["count"] for r in counts))))
    picked = sorted(tuple(r["c"]) for r in each.where(F.expr(f"pmod(xxhash64(h, c[0]), 1000000) < {rate}")).select("c").collect())
    weights = spark.sparkContext.broadcast(classifier(np.array([c[4:] for c in picked], np.int64).reshape(-1, SLOTS), np.array([em.posterior[c[1], c[3]] for c in picked])))
    voted = frozenset(em.reliability)  # kinds with a vote for any candidate

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, text = [[] for _ in BASE], [], []
            for b, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = list(zip(b[0::3], b[1::3], b[2::3]))
                for k in range(len(BASE)):
                    n[k].append(sum(s[1] == k for s in spans))
                sha.append(hashlib.sha256(_told(spans, kinds).encode()).hexdigest())
                loose = np.array(c, np.int64).reshape(-1, WIDTH)
                good = weights.value[loose[:, 4:]].sum(axis=1) > 0 if len(loose) else []
                more = [(x[0], x[1], x[2]) for x, g in zip(loose.tolist(), good) if g and x[1] in voted]
                text.append(_told(sorted(spans + more), kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(text, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return found.mapInArrow(tidy(tell), f"doc_id {id_type}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def _told(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
