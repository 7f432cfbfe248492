"""Personal data: plain patterns, and a linear-chain conditional random field for what they miss.

The patterns (email, ip, card, phone) are searched in whole texts. The random
field labels tokens by their shapes and their neighbours' shapes; it is trained
from a small labelled table made by ``labelled_table`` and decoded by Viterbi in
numpy batches. It labels every token of a whole text. Most tokens stand so far
outside its kinds that no transition could make up for it (``emissions``): these
are outside on any best path, so the text may be decoded in the parts between them
with the same result. Its spans are added where no pattern matched: numbers that fail the
patterns' checks but stand like personal data, spelled-out addresses, phone
numbers without a country code, and secrets.
"""

from __future__ import annotations

import functools
import itertools
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import bounded, ship_package, table, tidy

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
DIGIT = re.compile("[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

READ, DECODED = 1 << 19, 1 << 14  # bytes of text labelled at once; tokens decoded at once

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each at sign outwards: linear in the text, whatever it holds."""
    out, done = [], 0
    at = text.find("@")
    back = text[::-1] if at >= 0 else ""
    n = len(text)
    while at >= 0:
        local = LOCAL.match(back, n - at, n - done) if at > done else None
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            out.append((at - len(local[0]), domain.end(), "email"))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """All pattern spans (start, end, kind) in code points, by start, then kind as listed."""
    out = emails(text)
    if DIGIT.search(text):
        out += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# --- the random field -------------------------------------------------------

TOKEN = re.compile(r"[A-Za-zÀ-ÿ]+(?:[0-9][A-Za-z0-9]*)?|[0-9]+(?:[A-Za-z][A-Za-z0-9]*)?|[^\sA-Za-z0-9À-ÿ]")
#: Words that stand beside personal data.
CUES = {"at", "dot", "com", "net", "org", "mail", "email", "phone", "tel", "call", "mobile", "fax", "ip", "host", "server", "address", "card", "visa", "account", "iban", "token", "key", "secret", "password", "passwd", "api", "version", "page", "year", "section", "chapter"}


def token_shape(token: str) -> str:
    if token.isdigit():
        return f"d{min(len(token), 20)}"
    if token[0].isalnum():
        if len(token) >= 16 and re.fullmatch("[0-9a-fA-F]+", token) and DIGIT.search(token):
            return "hex"
        if DIGIT.search(token):
            return "mixed-long" if len(token) >= 16 else "mixed"
        low = token.lower()
        return low if low in CUES else "X" if token.isupper() else "Xx" if token[0].isupper() else "x"
    return token if token in "@.+()-=\"':/_,;[]<>#%!&$*|" else "sign"


def token_features(tokens: list[str]) -> list[list[str]]:
    s = ["<2", "<1", *map(token_shape, tokens), ">1", ">2"]
    return [["bias", f"0{s[i]}", f"-1{s[i - 1]}", f"-2{s[i - 2]}", f"+1{s[i + 1]}", f"+2{s[i + 2]}", f"-10{s[i - 1]} {s[i]}", f"0+1{s[i]} {s[i + 1]}", f"-101{s[i - 1]} {s[i]} {s[i + 1]}"] for i in range(2, len(s) - 2)]


def labelled_table(rows: int = 420, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """The training table: short texts with their spans, made by rule from a seed."""
    r = random.Random(seed)

    def word() -> str:
        w = "".join(r.choice(("th", "er", "on", "an", "re", "st", "en", "or", "ti", "es", "que", "ung", "ción", "é")) for _ in range(r.randint(1, 4)))
        return r.choice((w, w, w, w.capitalize(), w + ",", w + "."))

    def digits(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def host() -> str:
        return r.choice((f"mail{r.randint(1, 9)}.example.com", "example.org", "post.example.net", f"{word().strip('.,').lower()}.com"))

    def personal() -> tuple[str, str]:
        kind = r.choice(KINDS)
        name = r.choice((word().strip(".,").lower(), f"user.{r.randint(1, 99)}", f"the.{r.randint(1, 99)}", f"j_{word().strip('.,').lower()}"))
        if kind == "email":
            return r.choice((f"{name}@{host()}", f"{name}@{host()}", f"{name} at {host().replace('.', ' dot ')}", f"{name} [at] {host()}", f"{name}(at){host()}")), kind
        if kind == "ip":
            return ".".join(str(r.randint(0, 255)) for _ in range(4)), kind
        if kind == "card":
            d = digits(16)
            return r.choice((d, d, " ".join(d[k : k + 4] for k in range(0, 16, 4)), "-".join(d[k : k + 4] for k in range(0, 16, 4)), digits(15))), kind
        if kind == "phone":
            return r.choice((f"+1 ({digits(3)}) 555-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{r.randint(20, 99)} {digits(3)} {digits(4)} {digits(3)}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}")), kind
        return "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64)))), kind

    def harmless() -> str:
        return r.choice((f"version {r.randint(1, 9)}.", f"Version {r.randint(1, 9)}.{r.randint(0, 9)}.", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", f"{r.randint(1900, 2030)}", f"{r.randint(1, 999)}", f"{r.randint(1, 99)}.{digits(2)}", f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"{r.randint(10, 23)}:{r.randint(10, 59)}", f"page {r.randint(1, 400)}", f"{digits(3)},{digits(3)}", f"{digits(r.randint(5, 8))}", f"{r.randint(1, 99)}%", f"at {r.randint(1, 12)}", f"@{word().strip('.,')}", f"A{r.randint(1, 99)}", "x = 3", f"{r.randint(1, 20)}-{r.randint(21, 40)}", "one dot two", "(2)", f"[{r.randint(1, 99)}]"))

    out = []
    for _ in range(rows):
        text, spans = "", []
        tail = r.choice(("", "", "", "", "%%%", "###", "!!", "***", "&&&", "$$$", "|"))
        for _ in range(r.randint(2, 5)):
            for _ in range(r.randint(0, 5)):
                text += word() + tail + " "
            if r.random() < 0.55:
                value, kind = personal()
                lead = {"secret": ('token = "', "api_key: ", "secret=", ""), "email": ("", "", "mail: "), "phone": ("", "", "Tel. "), "card": ("", "", "card "), "ip": ("", "", "host ")}[kind]
                lead = r.choice(lead)
                text += lead
                spans.append((len(text), len(text) + len(value), kind))
                text += value + ('"' if lead.endswith('"') else "") + r.choice(("", "", "", ".", ",")) + tail + " "
            else:
                text += harmless() + tail + " "
        for _ in range(r.randint(0, 4)):
            text += word() + tail + " "
        if r.random() < 0.1:
            text = text.upper()
        out.append((text, spans))
    return out


class Field:
    """A linear-chain conditional random field; weights by feature name."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, step: np.ndarray, first: np.ndarray):
        self.names, self.weights, self.step, self.first = names, weights, step, first

    @classmethod
    def train(cls, rows: list[tuple[str, list[Span]]], rounds: int = 90, l2: float = 0.02) -> Field:
        """Maximum likelihood by forward-backward and Adam over the whole table."""
        seqs = []
        for text, spans in rows:
            marks = list(TOKEN.finditer(text))
            y = np.zeros(len(marks), dtype=int)
            for a, b, kind in spans:
                inside = [i for i, m in enumerate(marks) if m.start() < b and m.end() > a]
                y[inside] = LABELS.index(f"I-{kind}")
                y[inside[0]] = LABELS.index(f"B-{kind}")
            seqs.append((token_features([m[0] for m in marks]), y))
        seqs.sort(key=lambda s: len(s[1]))
        names: dict[str, int] = {}
        for f, _ in seqs:
            for x in f:
                for n in x:
                    names.setdefault(n, len(names))
        n, t_max, k = len(seqs), len(seqs[-1][1]), len(LABELS)
        where = [(i, t) for i, (_, y) in enumerate(seqs) for t in range(len(y))]
        si, ti = (np.array(w) for w in zip(*where))
        x = np.array([[names[g] for g in seqs[i][0][t]] for i, t in where])
        y = np.concatenate([s[1] for s in seqs])
        size = np.array([len(s[1]) for s in seqs])
        gold = np.zeros((len(y), k))
        gold[np.arange(len(y)), y] = 1
        same = si[1:] == si[:-1]
        gold_step = np.zeros((k, k))
        np.add.at(gold_step, (y[:-1][same], y[1:][same]), 1)
        gold_first = np.bincount(y[ti == 0], minlength=k).astype(float)
        params = [np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        alive = np.arange(t_max)[None, :] < size[:, None]
        for it in range(1, rounds + 1):
            w, step, first = params
            e = np.zeros((n, t_max, k))
            e[si, ti] = w[x].sum(axis=1)
            alpha, scale = np.zeros((n, t_max, k)), np.zeros((n, t_max, 1))
            es, top = np.exp(step), e.max(axis=2, keepdims=True)
            ee = np.exp(e - top)
            a = ee[:, 0] * np.exp(first)
            for t in range(t_max):
                if t:
                    a = (alpha[:, t - 1] @ es) * ee[:, t]
                scale[:, t] = a.sum(axis=1, keepdims=True)
                alpha[:, t] = a / scale[:, t]
            beta = np.ones((n, k))
            marg = np.zeros((n, t_max, k))
            pair = np.zeros((k, k))
            for t in range(t_max - 1, -1, -1):
                marg[:, t] = alpha[:, t] * beta
                marg[:, t] /= marg[:, t].sum(axis=1, keepdims=True)
                if t:
                    right = ee[:, t] * beta
                    both = alpha[:, t - 1][:, :, None] * es[None] * right[:, None, :]
                    both /= both.sum(axis=(1, 2), keepdims=True)
                    pair += both[alive[:, t]].sum(axis=0)
                    back = (right @ es.T) / scale[:, t]
                    beta = np.where(alive[:, t][:, None], back, 1.0)
            diff = marg[si, ti] - gold
            gw = np.zeros_like(w)
            for c in range(x.shape[1]):
                np.add.at(gw, x[:, c], diff)
            grads = [gw + l2 * w, pair - gold_step + l2 * step, marg[:, 0].sum(axis=0) - gold_first + l2 * first]
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                params[j] = params[j] - 0.1 * (m[j] / (1 - 0.9**it)) / (np.sqrt(v[j] / (1 - 0.999**it)) + 1e-8)
        return cls(names, *params)

    @functools.cached_property
    def tables(self) -> Tables:
        return Tables(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def emissions(self, texts: list[list[str]], cut: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which tokens may be inside a span, the scores of their labels, where each text begins and the end).

        A token is outside for certain if O beats every other label by more than the
        two transitions around it can differ, whatever its neighbours are: a path
        that had another label there would gain by taking O. Without ``cut``, all
        tokens may be inside.
        """
        t, first, step = self.tables, self.first, self.step
        gain = np.maximum((step - step[:, :1]).max(axis=0), first - first[0]) + np.maximum((step - step[:1]).max(axis=1), 0)
        size = np.array([len(x) for x in texts], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        n = int(begin[-1])
        at = np.arange(n) + 4 * np.repeat(np.arange(len(texts)), size) + 2  # two places before and after each text
        shapes = np.empty(n + 4 * len(texts), dtype=np.int16)
        for k, edge in enumerate(("<2", "<1", ">1", ">2")):
            shapes[begin[:-1] + 4 * np.arange(len(texts)) + k + (size if k > 1 else 0)] = t.shapes.get(edge, 0)
        shapes[at] = np.fromiter((t.ids[w] for x in texts for w in x), dtype=np.int16, count=n)
        inside, scores = np.ones(n, dtype=bool), [np.zeros((0, len(LABELS)))]
        for k in range(0, n, 1 << 16):
            a, b, s, d, e = (shapes[at[k : k + (1 << 16)] + j] for j in (-2, -1, 0, 1, 2))
            score = t.before[b, s] + t.after[s, d] + t.far[0][a] + t.far[1][e] + t.threes[t.row[b, s, d]]
            if cut:
                inside[k : k + len(s)] = (score[:, 1:] + gain[1:] >= score[:, :1]).any(axis=1)
                score = score[inside[k : k + len(s)]]
            scores.append(score)
        return inside, np.concatenate(scores), begin

    def decode(self, texts: list[list[str]], cut: bool = True) -> list[np.ndarray]:
        """Best labels of the tokens of each text, by Viterbi over batches of parts of like lengths.

        The parts are the runs of tokens that may be inside a span; without ``cut``, whole texts.
        """
        inside, e, begin = self.emissions(texts, cut)
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[begin] = True
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        fresh, last = edge[starts], edge[ends]  # at a text's border, or beside a token that is outside
        order = np.argsort(ends - starts, kind="stable")
        size = (ends - starts)[order]
        place = np.concatenate([[0], np.cumsum(inside)])[starts]  # of a part's first token among the scores
        y = np.zeros(len(inside), dtype=np.int64)
        at = 0
        while at < len(order):
            to = min(int(np.searchsorted(size, max(16, 2 * size[at]), side="right")), at + max(1, DECODED // int(size[at])))
            while to > at + 1 and (to - at) * size[to - 1] > 2 * DECODED:
                to = at + (to - at + 1) // 2
            who, n = order[at:to], size[at:to]
            for part, labels in zip(starts[who], self._viterbi(e, place[who], n, fresh[who], last[who])):
                y[part : part + len(labels)] = labels
            at = to
        return [y[a:b] for a, b in zip(begin[:-1], begin[1:])]

    def _viterbi(self, e: np.ndarray, start: np.ndarray, n: np.ndarray, fresh: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        rows, t_max = np.arange(len(start)), int(n.max())
        best = e[start] + np.where(fresh[:, None], self.first, self.step[0])
        come = np.zeros((t_max, *best.shape), dtype=np.int8)
        for t in range(1, t_max):
            live = t < n
            options = best[live][:, :, None] + self.step[None]
            come[t, live] = options.argmax(axis=1)
            best[live] = options.max(axis=1) + e[start[live] + t]
        y = np.zeros((len(start), t_max), dtype=np.int64)
        label = (best + np.where(last[:, None], 0, self.step[:, 0])).argmax(axis=1)
        y[rows, n - 1] = label
        for t in range(t_max - 1, 0, -1):
            live = t < n
            label = np.where(live, come[t, rows, label], label)
            y[live, t - 1] = label[live]
        return [labels[:k] for labels, k in zip(y, n)]


class ShapeIds(dict):
    """The number of a token's shape, 0 for shapes without a weight; long tokens are not kept."""

    def __init__(self, shapes: dict[str, int]):
        super().__init__()
        self.shapes = shapes

    def __missing__(self, token: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        found = self.shapes.get(token_shape(token), 0)
        if len(token) <= 64:
            self[token] = found
        return found


class Tables:
    """A field's weights by the numbers of shapes: pairs, single shapes two places off, and the triples it knows."""

    def __init__(self, field: Field):
        singles, pairs, triples = {}, {}, {}
        for name, at in field.names.items():
            spaces = name.count(" ")
            if name == "bias":
                continue
            kind = "-101" if spaces == 2 else name[:3] if spaces else name[: 1 if name[0] == "0" else 2]
            into = triples if spaces == 2 else pairs if spaces else singles
            into[kind, *name[len(kind) :].split(" ")] = field.weights[at]
        self.shapes = {s: k for k, s in enumerate(sorted({s for key in (*singles, *pairs, *triples) for s in key[1:]}), 1)}
        self.ids = ShapeIds(self.shapes)
        n, k = len(self.shapes) + 1, len(LABELS)
        single = {kind: np.zeros((n, k)) for kind in ("0", "-1", "-2", "+1", "+2")}
        for (kind, s), w in singles.items():
            single[kind][self.shapes[s]] = w
        bias = field.weights[field.names["bias"]]
        self.before = single["-1"][:, None] + single["0"][None] + bias  # the token before, the token
        self.after = np.broadcast_to(single["+1"][None], (n, n, k)).copy()  # the token, the token after
        for (kind, a, b), w in pairs.items():
            (self.before if kind == "-10" else self.after)[self.shapes[a], self.shapes[b]] += w
        self.far = single["-2"], single["+2"]
        self.threes = np.concatenate([np.zeros((1, k)), *(w[None] for w in triples.values())])
        self.row = np.zeros((n, n, n), dtype=np.int32)
        for at, (_, a, b, c) in enumerate(triples, 1):
            self.row[self.shapes[a], self.shapes[b], self.shapes[c]] = at


@functools.cache
def trained() -> Field:
    return Field.train(labelled_table())


def plausible(kind: str, value: str) -> bool:
    """Does a span of the field hold what its kind needs?"""
    n = sum(c.isdigit() for c in value)
    if kind == "email":
        return bool(re.search(r"@|\bat\b", value, re.I)) and bool(re.search(r"\.|\bdot\b", value, re.I)) and not value.startswith("@")
    if kind == "ip":
        return value.count(".") == 3 and n >= 4
    if kind == "card":
        return 13 <= n <= 19
    if kind == "phone":
        return 9 <= n <= 15 and not re.fullmatch("[0-9]+", value)
    return len(value) >= 16 and bool(re.search("[A-Za-z]", value))


def find(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, all spans) of each text."""
    out = []
    texts = [t or "" for t in texts]
    for text, y in zip(texts, field.decode([TOKEN.findall(t) for t in texts])):
        base, new = base_spans(text), []
        if y.any():
            marks = [m.span() for m in TOKEN.finditer(text)]
            inside = np.flatnonzero(y)
            for k, t in enumerate(inside):
                kind = LABELS[y[t]][2:]
                if k and inside[k - 1] == t - 1 and LABELS[y[t]] == f"I-{kind}" and new and new[-1][1] == marks[t - 1][1] and new[-1][2] == kind:
                    new[-1] = (new[-1][0], marks[t][1], kind)
                else:
                    new.append((*marks[t], kind))
        new = [s for s in new if plausible(s[2], text[s[0] : s[1]])]
        if base and new:
            begins, reach = [s[0] for s in base], list(itertools.accumulate((s[1] for s in base), max))
            # no base span that begins before a new one's end may reach beyond its start
            new = [s for s in new if not (k := bisect_left(begins, s[1])) or reach[k - 1] <= s[0]]
        out.append((base, sorted(base + new, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; spans that overlap become one."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a < at:
            if b > at:
                at = b
            continue
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): pattern spans and all spans of each row, as arrays of (kind, start, end).

    Defined results: null text is an empty one and has no spans; null ids are
    passed on; each row gives one row, repeated or not; an empty table gives an
    empty result; other columns are not read.
    """
    ship_package(docs.sparkSession)
    field = trained()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in bounded(b, 1, READ):
                found = find(part.column(1).to_pylist(), field)
                columns = [pa.array([[{"kind": n, "start": a, "end": e} for a, e, n in f[j]] for f in found], spans) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans in ``text_col`` replaced by their kinds.

    Defined results: null texts stay null, empty ones empty; each row gives one row,
    repeated or not; an empty table gives an empty result; other columns stay as they are.
    """
    ship_package(docs.sparkSession)
    field = trained()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in bounded(b, at, READ):
                texts = part.column(at).to_pylist()
                done = [t if t is None else redacted(t, f[1]) for t, f in zip(texts, find(texts, field))]
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()) if c == at else part.column(c) for c in range(part.num_columns)], names=part.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)


def op10_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))

    def text(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
