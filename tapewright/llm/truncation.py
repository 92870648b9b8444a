"""Problem 8: texts cut off by a field limit or in mid-transfer.

Texts are cut artificially; a hashed logistic regression learns to tell the cuts from the texts as they are, from closing
characters, punctuation, what is still open at the end, and the length against the source's limit; then every text is
scored. No rule decides a label: all texts count as whole at first, and those that a fit on other texts takes for cut are
left out of the next.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.operators.stage import Stage

#: Texts, about, that are used for training (chosen by hash of the key), cuts made of each, and one in so many held out.
TRAIN_TEXTS, CUTS, HELD_OUT = 6_000, 2, 5
#: Names of macros that stand for the begin or end of an environment, learned from preambles, the most often defined first.
MACROS = 4_096
#: Rounds in which texts that look cut are taken out of training, each judged by a fit on the other parts of so many.
ROUNDS, FOLDS = 3, 4
#: Epochs, rate and decay of those fits, and of the last.
CLEANING, LAST = (15, 0.08, 1e-4), (60, 0.2, 1e-5)
#: Hashed weights.
SIZE = 1 << 13
BLOCK = 512
#: From here to 1 cuts are made after lines.
LINES = 0.95
SEED = 11

#: What is put behind a cut.
MARKS = re.compile(r"(?:[\[(<{]\s*)?(?:\.{3,}|…+|\.…|(?<=[\[(<])\s*(?:truncated|cut|more|continued|snip|omitted))\s*(?:[\])>}])?$", re.I)
PUT_BEHIND = ("", "", "", "", " [...]", "...", "…", " (...)")

_DEFINE = r"\\(?:def|(?:re)?newcommand|providecommand)\s*\*?\s*\{?\s*\\([A-Za-z]+)\s*\}?\s*\{\s*\\(begin|end)\s*\{([^{}]*)\}\s*\}"
_MACRO = re.compile(_DEFINE)
_SKIPPED = re.compile(r"\\iffalse\b.*?\\fi\b", re.S)
_ENVIRONMENT = r"\\(?:(begin|end)\s*\{([^{}]*)\}%s)"
_PLAIN = re.compile(_ENVIRONMENT % "")
_HANDOVER = re.compile(r"(?:\\(?:input|include|subfile|import)\s*\{[^{}]*\}(?:\{[^{}]*\})?|\\input\s+[\w./-]+|\\endinput)$")
_WORD, _COMMAND = re.compile(r"\\?[A-Za-z]+$"), re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\[\]]*\])?(?:\{[^{}]*\})*$")
_LETTERS, _DIGITS, _START = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"\s*\(?\s*([^\W\d_]+|\\[A-Za-z]+)")


def uncommented(t: str) -> str:
    """Without comments: from a per cent sign that is not escaped to the end of its line."""
    out, start, at = [], 0, t.find("%")
    while at >= 0:
        slash = at
        while slash > start and t[slash - 1] == "\\":
            slash -= 1
        if (at - slash) % 2:
            at = t.find("%", at + 1)
            continue
        out.append(t[start:at])
        start = t.find("\n", at)
        if start < 0:
            return "".join(out)
        at = t.find("%", start)
    return "".join(out) + t[start:] if out else t


def _either(names: frozenset[str]) -> str:
    """A pattern of the names that shares their beginnings, so that its time does not depend on how many there are."""
    by: dict[str, set[str]] = {}
    for n in names:
        if n:
            by.setdefault(n[0], set()).add(n[1:])
    inner = "|".join(c + _either(frozenset(rest)) for c, rest in sorted(by.items()))
    return f"(?:{inner}){'?' if '' in names else ''}" if by else ""


@lru_cache(maxsize=256)
def _with_macros(names: frozenset[str]) -> re.Pattern:
    return re.compile(_ENVIRONMENT % rf"|({_either(names)})(?![A-Za-z])")


def _last_paragraph(t: str) -> str:
    end = len(t)
    while (at := t.rfind("\n", 0, end)) >= 0:
        before = t.rfind("\n", 0, at)
        if before >= 0 and not t[before + 1 : at].strip(" \t"):
            return t[at + 1 :]
        end = at
    return t


def _open_math(t: str) -> str:
    """The math that is open at the end: displays may hold blank lines, formulas within text end with their paragraph."""
    t = t.replace("\\\\", "  ").replace("\\$", "  ")
    if t.rfind("\\[") > t.rfind("\\]"):
        return "["
    p = _last_paragraph(t)
    if p.rfind("\\(") > p.rfind("\\)"):
        return "("
    if t.count("$$") % 2:
        return "$$"
    return "$" if (p.count("$") - 2 * p.count("$$")) % 2 else ""


def _kind(c: str) -> str:
    return "a" if c.isalpha() else "9" if c.isdigit() else "_" if c.isspace() else c


def closing(text: str, known: dict[str, tuple[str, str]]) -> tuple[list[str], int, str]:
    """Features of how a text ends; characters put behind a cut, white space before them included; its last character.

    Comments, drafts in ``\\iffalse`` and whatever follows the document's end do not count. ``known``: macros that stand for
    (begin or end, environment); used where the text has no preamble that could define them."""
    stripped = text.rstrip()
    at = max(0, len(stripped) - BLOCK)
    mark = MARKS.search(stripped, at)
    head = stripped[: mark.start()].rstrip() if mark else text
    behind = len(text) - len(head)
    t = head.replace("\r\n", "\n").replace("\r", "\n") if "\r" in head else head
    t = uncommented(t)
    if "\\iffalse" in t:
        t = _SKIPPED.sub("", t)
    preamble = "\\documentclass" in t or "\\documentstyle" in t
    macros = {} if preamble else known
    if "\\def" in t or "newcommand" in t or "providecommand" in t:
        own: dict[str, tuple[str, str]] = {}

        def define(m: re.Match) -> str:
            own[m[1]] = m[2], m[3]
            return ""

        t = _MACRO.sub(define, t)
        macros = macros | own if own else macros
    stack: list[str] = []
    for m in (_with_macros(frozenset(macros)) if macros else _PLAIN).finditer(t):
        kind, name = m[1], m[2]
        if kind is None:
            kind, name = macros[m[3]]
        if kind == "begin":
            stack.append(name)
        elif name == "document":
            return ["document closed"], behind, ""
        elif stack:
            stack.pop()
    inner = [x for x in stack if x != "document"]
    plain = t.replace("\\\\", "").replace("\\{", "").replace("\\}", "")
    braces = plain.count("{") > plain.count("}")
    math = _open_math(t)
    tail = t.rstrip()
    last = _kind(tail[-1:]) if tail else ""
    line = tail[tail.rfind("\n") + 1 :]
    handover = bool(_HANDOVER.search(line)) and not inner and not math
    short = line[-BLOCK:]
    word, command = _WORD.search(short[-64:]), _COMMAND.search(short)
    shape = _LETTERS.sub("a", _DIGITS.sub("9", short))[-16:]
    start = _DIGITS.sub("9", (_START.match(line) or ["", ""])[1][:64])
    above = tail[: len(tail) - len(line)]
    alone = above.endswith("\n\n") or not above
    state = "open" if preamble else "none"
    unclosed = bool(inner or math or braces or (preamble and not handover))
    slash = bool(word and word[0].startswith("\\"))
    f = [
        f"unclosed {unclosed}", f"unclosed {unclosed} {state}", f"unclosed {unclosed} last {last}", f"bare command {slash and word[0] != line.strip()}",
        f"document {state} handover {handover}", f"inner {bool(inner)}", f"math {math}", f"brace {braces}", f"inside {inner[-1] if inner else ''}",
        f"last {last}", f"last two {''.join(map(_kind, tail[-2:]))}", f"last three {''.join(map(_kind, tail[-3:]))}", f"mark {bool(mark)}",
        f"backslash {slash}", f"command {command[1] if command else ''}", f"whole {command[1] if command and command.end() - command.start() == len(line.strip()) else ''}",
        f"line end {head.endswith(chr(10))}", f"alone {alone} start {start}", f"alone {alone} shape {shape}",
        f"sentence {tail[-1:] in ('.', '!', '?')}", f"short {len(line) < 60} alone {alone} last {last}", f"empty {not tail}",
    ]
    return f, behind, last


def _hashed(f: list[str]) -> list[int]:
    return sorted({zlib.crc32(x.encode()) % SIZE for x in f})


def with_length(f: list[int], last: str, n: int, behind: int, limit: int | None) -> list[int]:
    """``f`` and the features of a length ``n``, ``behind`` characters of which were put behind, against the limit of its source."""
    length = n - behind
    if limit is None:
        room = "unlimited"
    else:
        left = 0.0 if n == limit else (limit - length) / limit
        room = "none" if left <= 0 else "0.5 %" if left <= 0.005 else "5 %" if left <= 0.05 else "much"
    block = n > 0 and (length % BLOCK == 0 or n % BLOCK == 0)
    return sorted({*f, *_hashed([f"room {room}", f"block {block}", f"room {room} block {block} last {last}", "bias"])})


def _cuts(text: str, seed: int, known: dict) -> list[tuple[list[int], str, int, int, bool]]:
    """Artificial cuts: at a limit (as if the source's limit lay there), at a multiple of ``BLOCK``, anywhere, or after
    a line, as a transfer by lines stops. Cuts within a are not made: the visible text may be whole there."""
    rng, out = random.Random(seed), []
    until = max((m.start() for m in re.finditer(r"\\end\s*\{document\}|\\enddoc\b", text)), default=len(text))
    for _ in range(4 * CUTS):
        if len(out) == CUTS or until < 80:
            break
        at, how = rng.randrange(40, until), rng.random()
        if 0.3 <= how < 0.6 and at > BLOCK:
            at -= at % BLOCK
        elif how >= LINES and 0 <= (end := text.find("\n", at)) < until:
            at = end + (how < (1 + LINES) / 2)
        if not text[at:until].strip():
            continue  # nothing is lost
        head, behind = text[:at], rng.choice(PUT_BEHIND)
        line = head[head.rfind("\n") + 1 :]
        if "%" in line and uncommented(line) != line:
            continue
        made = head.rstrip() + behind if behind else head
        f, more, last = closing(made, known)
        out.append((_hashed(f), last, len(made), more, how < 0.3))
    return out


def _features(known: dict[str, tuple[str, str]]):
    def run(chunks: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts, chosen in chunks:
            rows = []
            for key, text, pick in zip(keys, texts, chosen, strict=True):
                text = text or ""
                f, behind, last = closing(text, known)
                rows.append((_hashed(f), last, len(text), behind, _cuts(text, zlib.crc32(str(key).encode()), known) if pick else []))
            yield pd.DataFrame(rows, columns=["f", "last", "n", "behind", "cuts"])

    return F.pandas_udf(run, "f array<int>, last string, n int, behind int, cuts array<struct<f array<int>, last string, n int, behind int, at_limit boolean>>")


def environment_macros(docs: DataFrame, text: str, most: int = MACROS) -> dict[str, tuple[str, str]]:
    """Macros that the preambles of all texts define as the begin or end of an environment, by what most of them say; the
    ``most`` most often defined ones. Macros beyond are known in the texts that define them."""
    t = F.col(text)
    preamble = F.when(t.contains("\\documentclass") | t.contains("\\documentstyle"), F.substring_index(t, "\\begin{document}", 1))
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(preamble, F.lit(_DEFINE), F.lit(0)))).alias("d"))
    part = lambda i: F.regexp_extract("d", _DEFINE, i)
    n = each.groupBy(part(1).alias("name"), part(2).alias("kind"), part(3).alias("env")).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("name").agg(F.max(F.struct("n", "kind", "env")).alias("b"), F.sum("n").alias("all"))
    rows = best.orderBy(F.col("all").desc(), "name").limit(most).select("name", "b.kind", "b.env").collect()
    return {r["name"]: (r["kind"], r["env"]) for r in rows}


def fit(whole: list[list[int]], cut: list[list[int]], epochs: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression over sets of hashed features (Adagrad on shuffled batches; fixed seed), and what to
    add to a sum of weights so that both classes count alike."""
    w, g, x = np.zeros(SIZE + 1), np.full(SIZE + 1, 1e-6), whole + cut
    if not x:
        return w, 0.0
    pad = _padded(x)
    t, rng = np.array([0.0] * len(whole) + [1.0] * len(cut)), np.random.default_rng(SEED)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for b in range(0, len(x), 128):
            rows = pad[order[b : b + 128]]
            p = 1 / (1 + np.exp(-w[rows].sum(1)))
            grad = np.bincount(rows.ravel(), np.repeat((p - t[order[b : b + 128]]) / len(rows), pad.shape[1]), SIZE + 1) + decay * w
            grad[SIZE] = 0  # padding
            g += grad * grad
            w -= rate * grad / np.sqrt(g)
    return w, float(np.log(len(whole) / len(cut))) if whole and cut else 0.0


def _padded(x: list[list[int]]) -> np.ndarray:
    pad = np.full((len(x), max(map(len, x), default=1)), SIZE, np.int64)
    for i, f in enumerate(x):
        pad[i, : len(f)] = f
    return pad


def chances(model: tuple[np.ndarray, float], x: list[list[int]]) -> np.ndarray:
    return 1 / (1 + np.exp(-model[0][_padded(x)].sum(1) - model[1])) if len(x) else np.empty(0)


def _trained(train: list) -> tuple[tuple[np.ndarray, float], dict]:
    """The classifier, and of each source the artificial cuts held out and those of them that are recognised. train: rows of
    k, s, f, last, n, behind, limit, cuts."""
    whole, cut, held, part, cut_part = [], [], [], [], []
    for r in train:
        own = with_length(r["f"], r["last"], r["n"], r["behind"], r["limit"])
        cuts = [with_length(c["f"], c["last"], c["n"], c["behind"], c["n"] if c["at_limit"] else r["limit"]) for c in r["cuts"]]
        h = zlib.crc32(f"part {r['k']}".encode())
        if h % HELD_OUT:
            whole.append(own)
            cut += cuts
            part.append(h // HELD_OUT % FOLDS)
            cut_part += [part[-1]] * len(cuts)
        else:
            held += [(r["s"], c) for c in cuts]
    looks_cut = np.zeros(len(whole), bool)
    for _ in range(ROUNDS):
        chance = np.zeros(len(whole))
        for k in range(FOLDS):
            others = [x for x, p, bad in zip(whole, part, looks_cut, strict=True) if p != k and not bad]
            model = fit(others, [x for x, p in zip(cut, cut_part, strict=True) if p != k], *CLEANING)
            mine = np.flatnonzero(np.array(part) == k)
            chance[mine] = chances(model, [whole[i] for i in mine])
        looks_cut = chance > 0.5
    w, even = fit([x for x, bad in zip(whole, looks_cut, strict=True) if not bad], cut, *LAST)
    odds = (looks_cut.sum() + 1) / ((~looks_cut).sum() + 1)  # as common as cut texts are among the texts as they come
    model = w, even + float(np.log(odds))
    found: dict = {}
    for (s, _), p in zip(held, chances(model, [c for _, c in held]), strict=True):
        n, hit = found.get(s, (0, 0))
        found[s] = n + 1, hit + int(p >= 0.5)
    return model, found


def _scored(docs: DataFrame, key: str, text: str, source: str, stage: Stage) -> tuple[DataFrame, dict]:
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(source).alias("s"))
    share = min(1.0, TRAIN_TEXTS / max(1, d.count()))
    pick = F.pmod(F.xxhash64(F.lit("train"), "k"), F.lit(1 << 20)) < int(share * (1 << 20))
    udf = _features(environment_macros(d, "t"))
    rows = stage.put(d.select("k", "s", pick.alias("pick"), udf("k", "t", pick).alias("x")).select("k", "s", "pick", "x.*"))
    ends = rows.groupBy("s", (F.col("n") - F.col("behind")).alias("len")).agg(F.count(F.lit(1)).alias("c"))
    limits = ends.groupBy("s").agg(F.max(F.struct("len", "c")).alias("m")).filter((F.col("m.c") > 1) & (F.col("m.len") > 0)).select(F.col("s").alias("ls"), F.col("m.len").alias("limit"))
    rows = rows.join(limits, F.col("s").eqNullSafe(F.col("ls")), "left").drop("ls")
    model, held = _trained(rows.filter(F.col("pick") & (F.col("n") > 0)).select("k", "s", "f", "last", "n", "behind", "limit", "cuts").orderBy("k", "n").collect())

    @F.pandas_udf("double")
    def score(f: pd.Series, last: pd.Series, n: pd.Series, behind: pd.Series, limit: pd.Series) -> pd.Series:
        x = [with_length(a, b, m, e, None if pd.isna(li) else int(li)) for a, b, m, e, li in zip(f, last, n, behind, limit, strict=True)]
        return pd.Series(np.where(n.to_numpy() > 0, chances(model, x), 0.0))

    scored = rows.select(F.col("k").alias(key), F.col("s").alias(source), score("f", "last", "n", "behind", "limit").alias("score"))
    return scored.select(key, source, F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("truncated")), held


def truncation_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", stage: Stage | None = None) -> DataFrame:
    """``key``, ``source``, score (chance that the text is cut), truncated (score at least 0.5), for every row.

    Limits come from all texts: a source's limit is its greatest length (in characters, what was put behind a cut aside)
    if two or more texts have it. Macros for environments come from all preambles. About ``TRAIN_TEXTS`` texts, chosen by
    hash, and ``CUTS`` artificial cuts of each train the classifier; all of them count as whole at first, later those that a
    fit on other texts does not take for cut. Null and empty texts are not truncated (score 0). A null source is a source. Repeated
    rows are scored alike. No rows give none; other columns are not read.
    """
    return _scored(docs, key, text, source, stage or Stage(docs.sparkSession, "truncation"))[0]


def p8_found(spark, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "p8")
    return stage.finish(truncation_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), stage=stage).filter("truncated").select("doc_id"))


def p8_report(spark, sf_dir: str) -> DataFrame:
    """How often each source truncates, and how many of the artificial cuts of its texts that were held out are recognised."""
    stage = Stage(spark, "p8")
    s, held = _scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source", stage)
    cut = F.sum(F.col("truncated").cast("int"))
    by = s.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), cut.alias("truncated"), F.round(cut / F.count(F.lit(1)), 6).alias("truncated_share"))
    known = spark.createDataFrame([(k, n, round(hit / n, 6)) for k, (n, hit) in held.items()], "hs string, held_out_cuts int, recognised_share double")
    return stage.finish(by.join(known, by["source"].eqNullSafe(known["hs"]), "left").drop("hs"))
