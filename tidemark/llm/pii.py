"""PII by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans (e-mail, ip, card, phone by pattern and check digits) are always kept. The method adds
spans: a broad extractor proposes further candidates (written-out mail addresses, identity and bank
numbers, partly masked or short phone numbers, names after a title or in a gazetteer), and labelers
of three kinds vote on base and further candidates alike with yes, no or abstain:

* regex: the shape of the span (valid check digits, area form, known prefix),
* gazetteer: given names (those listed here and any that the caller adds), titles, mail hosts,
* context: the words before the span (call, mail, phone, account, born, ...).

Votes of all documents are counted by pattern in Spark. The number of patterns is bounded by the
labelers (``3 ** labelers`` for each kind), so the counts are all that the driver sees.
Expectation-maximisation estimates each labeler's reliability and the posterior of each pattern;
a logistic span classifier is fitted to these posteriors weighted by their counts, with the votes
and the kind as features. A candidate whose probability reaches ``threshold`` is a span.

Defined results: a null or empty text has no spans; texts may have any length and are read whole,
every pattern in linear time; repeated rows give repeated results; an empty table trains a model
without evidence that adds nothing; other columns pass through, a column with the name of the
result is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import append_struct, column, columns, free_name, map_batches, materialize, steps

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds, in the order used for sorting after the base kinds.
MORE_KINDS = ("name", "idnum", "iban", "obfuscated", "localphone")
KINDS = BASE_KINDS + MORE_KINDS
THRESHOLD = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

# Words of the gazetteer and context labelers.
TITLES = ("mr", "mrs", "ms", "miss", "sir", "lady", "dr", "prof", "professor", "doctor", "herr", "frau", "señor", "señora", "señorita", "don", "doña", "monsieur", "madame", "mademoiselle", "mme", "mlle")
GIVEN_NAMES = (
    "aaron", "adam", "agnes", "alan", "albert", "alejandro", "alex", "alexander", "alice", "alicia", "amanda", "amy", "ana", "andrea", "andreas", "andrew", "angela", "ann", "anna", "anne", "anthony", "antoine", "antonio", "barbara", "beatriz", "benjamin", "bernd", "brian", "carl", "carla", "carlos", "carmen",
    "carol", "caroline", "catherine", "charles", "charlotte", "chloe", "christian", "christine", "christopher", "claire", "claudia", "clara", "cristina", "daniel", "david", "deborah", "denis", "diana", "diego", "dieter", "donald", "dorothy", "edward", "elena", "elizabeth", "emily", "emma", "eric", "ernst", "eva",
    "felix", "fernando", "francisco", "frank", "franz", "friedrich", "gabriel", "george", "gerhard", "grace", "greta", "hanna", "hannah", "hans", "heinrich", "helen", "helga", "henry", "hugo", "ines", "ingrid", "isabel", "isabelle", "jack", "jacob", "jacques", "james", "jan", "jane", "javier", "jean", "jennifer",
    "jessica", "joan", "joao", "johann", "john", "jonas", "jorge", "jose", "josé", "joseph", "juan", "julia", "julie", "jürgen", "karen", "karin", "karl", "katharina", "kevin", "klaus", "laura", "lea", "lena", "leon", "linda", "lisa", "louis", "louise", "lucas", "lucia", "luis", "lukas", "manuel", "marco",
    "margaret", "maria", "maría", "marie", "mario", "mark", "marta", "martin", "mary", "matthew", "max", "michael", "michel", "miguel", "monika", "nancy", "natalie", "nicolas", "nina", "olivia", "otto", "pablo", "patricia", "paul", "paula", "pedro", "peter", "philip", "pierre", "rachel", "rafael", "ramon",
    "rebecca", "richard", "robert", "rosa", "ruth", "samuel", "sandra", "sara", "sarah", "simon", "sofia", "sophie", "stefan", "stephen", "susan", "teresa", "thomas", "ursula", "victor", "walter", "william", "wolfgang",
)
MAIL_HOSTS = ("example", "gmail", "mail", "outlook", "proton", "yahoo", "hotmail", "web", "gmx", "icloud")
CONTEXT_WORDS = ("account", "address", "born", "call", "card", "contact", "correo", "email", "e-mail", "fax", "iban", "ip", "konto", "llamar", "mail", "mobile", "name", "passport", "phone", "reach", "ssn", "tel", "telefon", "telephone", "téléphone", "visa", "write")

_GAZETTEER = frozenset(GIVEN_NAMES)
_TITLED = frozenset(TITLES)
_CONTEXT = frozenset(CONTEXT_WORDS)
# Capitalised words in a row (group 1); which of them begin with a title or a given name is looked up after the match.
# Whether a row begins in a word is the same for all its capitals, so each word is tried once, at its beginning.
_CAPITALS = re.compile(r"(?<![\w'-])(?:[^\WA-ZÀ-ÖØ-Þ]|['-])*+([A-ZÀ-ÖØ-Þ][\w'-]*+\.?(?: [A-ZÀ-ÖØ-Þ][\w'-]++)++)")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ][\w'-]*\.?")
_IDNUM = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_OBFUSCATED = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}){1,8}")
_LOCALPHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")

LABELERS = ("shape", "gazetteer", "context", "spacing")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Matches of the e-mail pattern, found from each @ outwards, so that long words cost no more."""
    upto, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > upto and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            upto = m.end()
            at = text.find("@", upto)
        else:
            # A local part has no @, so no later match can reach back beyond this one.
            upto = at + 1
            at = text.find("@", upto)


def _ips(text: str):
    """Each maximal dotted run of numbers is cut into groups of four from the left."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts = [m.span() for m in _DIGITS.finditer(text, *run.span())]
        for i in range(0, len(parts) - 3, 4):
            group = parts[i : i + 4]
            if all(b - a <= 3 or not text[a : b - 3].strip("0") for a, b in group) and all(int(text[max(a, b - 3) : b]) <= 255 for a, b in group):
                yield group[0][0], group[3][1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns in code points, by start and then kind as listed."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if not _HAS_DIGIT(text):
        return found
    found += [(a, b, "ip") for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_HAS_DIGIT = re.compile(r"[0-9]").search


def _names(text: str, given: frozenset[str]):
    """A title or given name and the one or two capitalised words after it, without overlap."""
    for run in _CAPITALS.finditer(text):
        if run.start(1) and text[run.start(1) - 1].isalnum():
            continue
        parts = [m.span() for m in _CAPITAL.finditer(text, *run.span(1))]
        i = 0
        while i + 1 < len(parts):
            word = text[slice(*parts[i])].lower()
            if word in given or word.rstrip(".") in _TITLED:
                last = i + 1
                if i + 2 < len(parts) and text[parts[last][1] - 1] != ".":
                    last += 1
                yield parts[i][0], parts[last][1] - (text[parts[last][1] - 1] == ".")
                i = last + 1
            else:
                i += 1


def more_spans(text: str, base: list[tuple[int, int, str]], given: frozenset[str] = _GAZETTEER) -> list[tuple[int, int, str]]:
    """Further candidates that do not overlap a base span; the first kind in order wins.

    Spans taken so far are kept in order and without overlap, so each pattern's matches, which come in
    order too, pass them by once.
    """
    taken: list[tuple[int, int]] = []
    for a, b, _ in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    found: list[tuple[int, int, str]] = []
    kinds: list[tuple[str, object]] = [("name", _names(text, given))]
    if _HAS_DIGIT(text):
        kinds += [(k, (m.span() for m in p.finditer(text))) for k, p in (("idnum", _IDNUM), ("iban", _IBAN), ("localphone", _LOCALPHONE))]
    if "at" in text and ("[" in text or "(" in text):
        kinds.append(("obfuscated", (m.span() for m in _OBFUSCATED.finditer(text))))
    for kind, spans in kinds:
        new, at = [], 0
        for a, b in spans:
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if at == len(taken) or b <= taken[at][0]:
                new.append((a, b))
        if new:
            found += [(a, b, kind) for a, b in new]
            taken = sorted(taken + new)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_WORDS_BEFORE = re.compile(r"[\w-]+", re.UNICODE)


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, span: tuple[int, int, str], given: frozenset[str] = _GAZETTEER) -> tuple[int, ...]:
    """One of -1 (no), 0 (abstain), 1 (yes) from each labeler, in the order of LABELERS."""
    a, b, kind = span
    s = text[a:b]
    before = [w.lower() for w in _WORDS_BEFORE.findall(text, max(0, a - 40), a)][-4:]
    shape = 0
    if kind == "email":
        shape = 1 if s.rpartition(".")[2].isalpha() and len(s) <= 254 else -1
    elif kind == "ip":
        shape = -1 if s.startswith(("0.", "127.", "255.")) else 1
    elif kind == "card":
        shape = 1 if len(set(s) - {" ", "-"}) > 2 else -1
    elif kind == "phone":
        shape = 1
    elif kind == "idnum":
        shape = 1 if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else -1
    elif kind == "iban":
        shape = 1 if _iban_ok(s) else -1
    elif kind == "localphone":
        shape = 1 if s.strip("(")[0] not in "01" else -1
    elif kind == "name":
        shape = 1 if s.count(" ") >= 1 else -1
    gazetteer = 0
    words = [w.lower() for w in _WORDS_BEFORE.findall(s)]
    if kind in ("email", "obfuscated"):
        gazetteer = 1 if any(w.rstrip("0123456789") in MAIL_HOSTS for w in words) else 0
    elif kind == "name":
        gazetteer = 1 if any(w in given for w in words) or words and words[0] in _TITLED else -1
    context = 1 if any(w in _CONTEXT for w in before) else 0
    left, right = text[a - 1 : a], text[b : b + 1]
    spacing = 1 if (not left or left.isspace() or left in "\"'(<[:,;") and (not right or not (right.isalnum() or right in "_@")) else -1
    return shape, gazetteer, context, spacing


@dataclass(frozen=True)
class SpanModel:
    """The prior, each labeler's share of right votes, and the weights of the span classifier."""

    prior: float
    accuracy: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    threshold: float = THRESHOLD

    def probability(self, kind: str, v: tuple[int, ...]) -> float:
        x = _features(kind, v)
        return float(1 / (1 + np.exp(-(np.dot(self.weights, x) + self.bias))))


def _features(kind: str, v: tuple[int, ...]) -> np.ndarray:
    return np.array([float(x == 1) for x in v] + [float(x == -1) for x in v] + [float(kind == k) for k in KINDS])


def fit(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 50, threshold: float = THRESHOLD) -> SpanModel:
    """EM over vote patterns, then a count-weighted logistic regression on the posteriors."""
    m = len(LABELERS)
    if not counts:
        return SpanModel(0.5, (0.5,) * m, (0.0,) * (2 * m + len(KINDS)), -10.0, threshold)
    v = np.array([c[1] for c in counts], dtype=int)
    n = np.array([c[2] for c in counts], dtype=float)
    # How often each labeler votes -1, 0 and 1 on spans that are none and on spans that are one. A labeler that
    # votes alike on both says nothing, however often it is "right"; the counts added keep a few spans from deciding.
    start = np.array([[0.6, 0.3, 0.1], [0.05, 0.35, 0.6]])
    table = np.repeat(start[:, None, :], m, axis=1)
    prior, at = 0.7, np.arange(m)
    post = np.full(len(n), 0.5)
    for _ in range(rounds):
        no, yes = (np.log(p) + np.log(table[c][at, v + 1]).sum(1) for c, p in ((0, 1 - prior), (1, prior)))
        post = 1 / (1 + np.exp(np.clip(no - yes, -60, 60)))
        prior = float(np.clip((post @ n + 2) / (n.sum() + 4), 0.01, 0.99))
        for c, share in ((0, (1 - post) * n), (1, post * n)):
            for vote in (-1, 0, 1):
                table[c, :, vote + 1] = ((v == vote) * share[:, None]).sum(0) + 4 * start[c, vote + 1]
            table[c] /= table[c].sum(1, keepdims=True)
    right = prior * table[1, :, 2] + (1 - prior) * table[0, :, 0]
    wrong = prior * table[1, :, 0] + (1 - prior) * table[0, :, 2]
    acc = np.clip(right / (right + wrong), 0.5, 1)
    x = np.array([_features(k, tuple(int(a) for a in row)) for (k, _, _), row in zip(counts, v, strict=True)])
    share = n / n.sum()
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = share * (p - post)
        w -= 2.0 * (x.T @ g + 1e-4 * w)
        b -= 2.0 * float(g.sum())
    return SpanModel(prior, tuple(float(a) for a in acc), tuple(w), float(b), threshold)


CANDIDATES = "base array<struct<start: int, end: int, kind: string>>, more array<struct<start: int, end: int, kind: string, votes: array<int>>>, patterns array<struct<kind: string, votes: array<int>>>"


def _candidates(text: str, given: frozenset[str]) -> dict:
    base = base_spans(text)
    more = more_spans(text, base, given)
    voted = [list(votes(text, s, given)) for s in more]
    return {
        "base": [{"start": a, "end": b, "kind": k} for a, b, k in base],
        "more": [{"start": s[0], "end": s[1], "kind": s[2], "votes": v} for s, v in zip(more, voted, strict=True)],
        "patterns": [{"kind": s[2], "votes": list(votes(text, s, given))} for s in base] + [{"kind": s[2], "votes": v} for s, v in zip(more, voted, strict=True)],
    }


def candidates(docs: DataFrame, text: str = "text", out: str = "__pii", given_names=()) -> DataFrame:
    """Documents with base spans, further candidates and their votes; ``given_names`` extend the gazetteer."""
    given = _GAZETTEER | {n.lower() for n in given_names}
    return append_struct(docs, text, out, CANDIDATES, lambda: lambda texts: [_candidates(t, given) for t in pc.fill_null(texts, "").to_pylist()])


def train(found: DataFrame, out: str = "__pii", threshold: float = THRESHOLD) -> SpanModel:
    """The model from the candidates of all documents; only counts by pattern reach the driver."""
    seen = found.select(F.explode(F.col(f"{out}.patterns")).alias("p")).groupBy("p.kind", "p.votes").count()
    rows = [(r["kind"], tuple(r["votes"]), r["count"]) for r in seen.collect()]
    return fit(sorted(rows), threshold=threshold)


def decide(found: DataFrame, model: SpanModel, out: str = "spans", candidates_column: str = "__pii") -> DataFrame:
    """Base spans, and of the others those that the classifier accepts, sorted by start and kind."""
    c = column(candidates_column)
    x = lambda s: F.concat(
        F.transform(s["votes"], lambda v: (v == 1).cast("double")), F.transform(s["votes"], lambda v: (v == -1).cast("double")), F.array(*[(s["kind"] == k).cast("double") for k in KINDS])
    )
    weights = F.array(*[F.lit(w) for w in model.weights])
    logit = lambda s: F.aggregate(F.zip_with(x(s), weights, lambda a, b: a * b), F.lit(float(model.bias)), lambda acc, y: acc + y)
    floor = float(np.log(model.threshold / (1 - model.threshold)))
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    shape = lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    added = F.transform(F.filter(c["more"], lambda s: logit(s) >= floor), shape)
    return found.withColumn(out, F.array_sort(F.concat(F.transform(c["base"], shape), added)))


def find_pii(docs: DataFrame, text: str = "text", out: str = "spans", threshold: float = THRESHOLD, keep_text: bool = True, found_as: str = "__pii", given_names=()) -> DataFrame:
    """Documents with ``out``: array of (start, rank, end, kind) by start and kind.

    The candidates of all documents are written once, next to the row, to the shared folder: the
    model is fitted on them and then applied to them, so no text is scanned twice. Without
    ``keep_text`` the text column is dropped before that. The base spans are in the struct ``found_as``.
    """
    found = candidates(docs, text, found_as, given_names)
    found = materialize(found if keep_text else found.drop(text), "pii")
    return decide(found, train(found, found_as, threshold), out, found_as)


def _masked(text: str, spans: list[dict]) -> str:
    done, at = [], 0
    for s in spans:
        if s["start"] >= at:
            done += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*done, text[at:]])


def mask_pii(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, length: str | None = None, given_names=()) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans are one.

    A null text stays null. Columns and their order stay. If ``length`` names a column, it gets the
    new length of texts that have spans; nothing else of a row changes. Each text is put together
    once from its pieces, in time linear in its length.
    """
    spans, seen = free_name(docs, "__spans"), free_name(docs, "__pii")
    found = find_pii(docs, text, spans, threshold, found_as=seen, given_names=given_names).select(*columns(docs), spans)

    def run(batches):
        for step in steps(batches, text):
            at = step.schema.get_field_index(text)
            hit = np.flatnonzero(pc.greater(pc.fill_null(pc.list_value_length(step.column(spans)), 0), 0).to_numpy(zero_copy_only=False))
            arrays = dict(zip(step.schema.names, step.columns, strict=True))
            if len(hit):
                texts = arrays[text].to_pylist()
                for i in hit.tolist():
                    texts[i] = _masked(texts[i], arrays[spans][i].as_py())
                arrays[text] = pa.array(texts, step.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=step.schema.names)

    out = map_batches(found, run, found.schema)
    if length:
        out = out.withColumn(length, F.when(F.size(spans) == 0, column(length)).otherwise(F.length(column(text))).cast(docs.schema[length].dataType))
    return out.select(*columns(docs))
