"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give base spans, which always stay. The field then looks at everything
that resembles one: numbers and @-tokens that fail a pattern's check or are written
differently. Its nodes are these candidates and the base spans of one document, in text
order. Neighbours are linked in a chain; nodes with the same content, or the same last
digits or local part, are linked over any distance to the next such node. Loopy message
passing over all nodes makes labels of linked nodes agree unless their own shape
speaks against it, so a number given once as ``+1 (743) 555-3824`` is also found as ``743-555-3824``.

Weights are trained here from counts over all documents: node weights by logistic
regression on shapes (base spans carry their kind, candidates count as other unless they repeat a base span), edge
weights as smoothed mutual information of labels at the ends of links.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import bounded_batches, cut_lineage

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)

# The base patterns. The e-mail pattern is applied around each @, see _emails.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[0-9](?:(?:(?!\.\x20)[\x20().-]){0,3}[0-9])*")  # not over the end of a sentence
_AT_TOKEN = re.compile(r"[^\s@,;<>()]+@[^\s@,;<>()]+")
_NOT_DIGITS = re.compile(r"[^0-9]+")

NODES = "array<struct<label: int, start: int, end: int, code: int, same: string, near: string>>"


# --- base spans -------------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches that pass their check, by kind, then start."""
    spans = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
        spans += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if _luhn(m[0])]
        if "+" in text:
            spans += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the whole run of local-part characters before an @ and the domain after it."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        head = text[done:at]
        start = done + len(head.rstrip(_LOCAL))
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            found.append((start, tail.end()))
            done = tail.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return found


def _digits(text: str) -> str:
    return _NOT_DIGITS.sub("", text)


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _luhn(text: str) -> bool:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19:
        return False
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    odd = sum(int(x) for x in digits[-1::-2])
    return (odd + sum(double[int(x)] for x in digits[-2::-2])) % 10 == 0


# --- nodes of the field -----------------------------------------------------------------


def nodes_of(text: str) -> list[dict]:
    """Base spans and candidates of one text in order of their starts."""
    base = base_spans(text)
    if not base and "@" not in text and not _DIGIT.search(text):
        return []
    taken = sorted((s, e) for _, s, e in base)
    nodes = [_node(text, kind, s, e) for kind, s, e in base]
    found = [m.span() for m in _AT_TOKEN.finditer(text)] if "@" in text else []
    found += [_widened(text, *m.span()) for m in _NUMBER.finditer(text)]
    at = 0
    for start, end in sorted(found):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end:
            continue  # overlaps a base span
        nodes.append(_node(text, OTHER, start, end))
    nodes.sort(key=lambda n: (n["start"], n["end"], n["label"]))
    return nodes


def _widened(text: str, start: int, end: int) -> tuple[int, int]:
    while start and text[start - 1] in "(+":
        start -= 1
        if text[start] == "+":
            break
    return start, end


def _node(text: str, label: int, start: int, end: int) -> dict:
    piece = text[start:end]
    if "@" in piece:
        local, _, domain = piece.lower().partition("@")
        return {"label": label, "start": start, "end": end, "code": _CODE_AT + ("." in domain), "same": piece.lower(), "near": local}
    digits = _digits(piece)
    shape = (
        piece.count(".") == 3, _luhn(piece), piece[0] == "+" or "(+" in piece[:2], "(" in piece,
        " " in piece or "-" in piece, all(len(p) <= 3 for p in piece.split(".")),
    )
    code = min(len(digits), 20) + sum(32 << i for i, x in enumerate(shape) if x)
    return {
        "label": label, "start": start, "end": end, "code": code, "same": digits,
        "near": digits[-7:] if len(digits) >= 7 else None,
    }


_CODE_AT = 32 << 6
_FEATURES = 21 + 6 + 3


def _features(codes: np.ndarray) -> np.ndarray:
    """One row of 0/1 features per shape code: digit count, six marks, @, @ with a dot, always on."""
    out = np.zeros((len(codes), _FEATURES))
    at = codes >= _CODE_AT
    rows = np.flatnonzero(~at)
    out[rows, np.minimum(codes[rows] % 32, 20)] = 1
    for i in range(6):
        out[rows, 21 + i] = codes[rows] >> (5 + i) & 1
    out[at, 27] = 1
    out[at, 28] = codes[at] & 1
    out[:, 29] = 1
    return out


def _links(documents: list[list[dict]]) -> tuple[np.ndarray, np.ndarray]:
    """Chain links and skip links (pairs of node numbers) of the nodes of all documents, one after another."""
    chain, skip, first = [], [], 0
    for nodes in documents:
        chain += [(i, i + 1) for i in range(first, first + len(nodes) - 1)]
        last: dict[tuple, int] = {}
        for i, node in enumerate(nodes, first):
            joined = set()
            for key in (("same", node["same"]), ("near", node["near"])):
                if key[1]:
                    if key in last and last[key] not in joined:
                        skip.append((last[key], i))
                        joined.add(last[key])
                    last[key] = i
        first += len(nodes)
    return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


# --- training and inference -------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """Node weights (features x labels), chain and skip potentials (labels x labels), all in logs."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    @cached_property
    def shape_scores(self) -> np.ndarray:
        """Scores of the labels for every shape code, largest 0."""
        score = _features(np.arange(_CODE_AT + 2)) @ self.unary
        return score - score.max(1, keepdims=True)


def fit(nodes: DataFrame) -> Field:
    """Train on column ``nodes`` of all rows.

    What reaches the driver is counts: of (shape code, label) where the label is known, and of label pairs at links;
    their number is bounded by the codes and labels, whatever the documents hold.
    """

    def count(batches):
        for batch in batches:
            documents = batch.column(0).to_pylist()
            labels = np.array([n["label"] for d in documents for n in d], np.int64)
            codes = np.array([n["code"] for d in documents for n in d], np.int64)
            known = ~np.array([x for d in documents for x in _open(d)], bool)
            found = [(np.full(known.sum(), 2), codes[known], labels[known])]
            for kind, links in enumerate(_links(documents)):
                found.append((np.full(len(links), kind), labels[links[:, 0]], labels[links[:, 1]]))
            keys, n = np.unique(np.concatenate([np.stack(x) for x in found], axis=1), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (*keys, n)], ["kind", "a", "b", "n"])

    counted = nodes.select("nodes").where("size(nodes) > 0").mapInArrow(count, "kind long, a long, b long, n long")
    table, shapes = np.zeros((2, OTHER + 1, OTHER + 1)), []
    for row in counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        if row.kind == 2:
            shapes.append((row.a, row.b, row.n))
        else:
            table[row.kind, row.a, row.b] = row.n
    return Field(_logistic(shapes), _agreement(table[0], 1.0), _agreement(table[1], 6.0))


def _open(nodes: list[dict]) -> list[bool]:
    """Per node, whether it is a candidate that repeats a base span of its document: its true label is open."""
    spoken = {(k, n[k]) for n in nodes if n["label"] != OTHER for k in ("same", "near") if n[k]}
    return [n["label"] == OTHER and any((k, n[k]) in spoken for k in ("same", "near")) for n in nodes]


def _logistic(shapes, steps: int = 400, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    weights = np.zeros((_FEATURES, OTHER + 1))
    if not shapes:
        weights[-1, OTHER] = 1.0
        return weights
    codes, label, n = np.array(sorted(shapes), np.int64).T
    x = _features(codes)
    share = np.sqrt(n)  # frequent shapes do not drown rare ones
    share /= share.sum()
    for _ in range(steps):
        score = x @ weights
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(label)), label] -= 1
        weights -= rate * (x.T @ (p * share[:, None]) + decay * weights)
    return weights


def _agreement(counts: np.ndarray, most: float) -> np.ndarray:
    """Smoothed log of how much more often two labels meet than by chance, at most ``most`` either way.

    Pairs of a base span and a candidate say nothing, as a candidate's true label is open; they count as 0.
    """
    both = counts + counts.T
    both[OTHER, :OTHER] = both[:OTHER, OTHER] = 0
    both = both + 0.5
    both /= both.sum()
    alone = both.sum(1)
    return np.clip(np.log(both / np.outer(alone, alone)), -most, most)


def beliefs(documents: list[list[dict]], model: Field, settled: float = 1e-4) -> np.ndarray:
    """Log belief in each label of all nodes, one document after another, largest 0.

    A message is worked out again only while it moves or something that flows into it does, so each document
    comes to rest by itself, whichever others are worked on with it. Damped influence moves about half a link a
    round: a document has four rounds a node, and 100 more, before it is taken as it is.
    """
    sizes = np.array([len(d) for d in documents], np.int64)
    labels = np.array([n["label"] for d in documents for n in d], np.int64)
    score = model.shape_scores[np.array([n["code"] for d in documents for n in d], np.int64)]
    base = np.flatnonzero(labels != OTHER)
    score[base] = -50.0
    score[base, labels[base]] = 0.0
    chain, skip = _links(documents)
    links = np.concatenate([chain, skip])
    potential = np.concatenate([np.repeat(model.chain[None], len(chain), 0), np.repeat(model.skip[None], len(skip), 0)])
    source = np.concatenate([links[:, 0], links[:, 1]])
    target = np.concatenate([links[:, 1], links[:, 0]])
    potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
    rounds = np.repeat(4 * sizes + 100, sizes)[source]
    messages, belief = np.zeros((len(source), OTHER + 1)), score.copy()
    awake, done = np.arange(len(source)), 0
    while len(awake):
        out = belief[source[awake]] - messages[back[awake]]
        new = np.logaddexp.reduce(out[:, :, None] + potential[awake], axis=1)
        new -= new.max(1, keepdims=True)
        step = 0.5 * (new - messages[awake])
        messages[awake] += step
        np.add.at(belief, target[awake], step)
        moved = awake[np.abs(step).max(1) >= settled]
        stirred = np.zeros(len(score), bool)
        stirred[target[moved]] = True
        wake = stirred[source]
        wake[moved] = True
        done += 1
        awake = np.flatnonzero(wake & (rounds > done))
    belief = score.copy()  # summed afresh, without the roundings of many steps
    np.add.at(belief, target, messages)
    return belief - belief.max(1, keepdims=True)


def infer(documents: list[list[dict]], model: Field) -> np.ndarray:
    """Labels of all nodes, one document after another; base spans keep theirs."""
    labels = np.array([n["label"] for d in documents for n in d], np.int64)
    if not len(labels):
        return labels
    return np.where(labels != OTHER, labels, beliefs(documents, model).argmax(1))


# --- operator ---------------------------------------------------------------------------


def personal_data(docs: DataFrame, carry: dict[str, Column], text: str = "text") -> DataFrame:
    """Per row of ``docs``: the carried columns, ``base`` and ``spans``: arrays of (kind, start, end), by kind, then start.

    Kinds are numbers of KINDS, places are code points, ends exclusive. Null and empty texts have no spans. Texts of any
    length count whole, and a document's labels do not depend on which others share its batch. Repeated rows stay. Without documents, or without anything like personal data, nothing is added.
    """

    def find(texts: pa.Array) -> pa.Array:
        return pa.array([nodes_of(x.as_py() or "") for x in texts], _NODE_TYPE)

    rows = bounded_batches(docs).select(*[c.alias(n) for n, c in carry.items()], F.arrow_udf(find, NODES)(F.col(text).cast("string")).alias("nodes"))
    rows = cut_lineage(rows)
    model = fit(rows)

    def label(nodes: pa.Array) -> pa.Array:
        documents = nodes.to_pylist()
        found = infer(documents, model).tolist()
        out, at = [], 0
        for items in documents:
            own = found[at : at + len(items)]
            at += len(items)
            spans = [(k, n["start"], n["end"]) for k, n in zip(own, items) if k != OTHER]
            out.append([{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans)])
        return pa.array(out, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))

    spans = F.arrow_udf(label, "array<struct<kind: int, start: int, end: int>>")("nodes")
    base = F.transform(
        F.filter("nodes", lambda n: n["label"] != OTHER),
        lambda n: F.struct(n["label"].alias("kind"), n["start"].alias("start"), n["end"].alias("end")),
    )
    return rows.select(*carry, F.array_sort(base).alias("base"), spans.alias("spans"))


_NODE_TYPE = pa.list_(pa.struct([
    ("label", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32()), ("same", pa.string()), ("near", pa.string()),
]))


def listed(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
