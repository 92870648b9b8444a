"""Packing, mixing and truncation on small inputs."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tapewright.llm import mixing, packing, truncation
from tapewright.llm.tokens import RANKS, _encoding


def fewest(sizes, capacity):
    """Containers of an optimal packing, by exhaustion."""
    best = [len(sizes)]

    def go(left, n):
        if n >= best[0]:
            return
        if not left:
            best[0] = n
            return
        first, rest = left[0], left[1:]
        for k in range(len(rest), -1, -1):
            for extra in combinations(range(len(rest)), k):
                if first + sum(rest[i] for i in extra) <= capacity:
                    go([x for i, x in enumerate(rest) if i not in extra], n + 1)

    go(sorted(sizes, reverse=True), 0)
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal_on_small_inputs(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(8, 60) for _ in range(9)]
    plan, _ = packing.bin_completion(Counter(sizes), 100)
    assert Counter(s for items, k in plan for s in items for _ in range(k)) == Counter(sizes)
    assert all(sum(items) <= 100 for items, _ in plan)
    assert sum(k for _, k in plan) == fewest(sizes, 100) >= packing.lower_bound(Counter(sizes), 100)


def test_bin_completion_beats_best_fit():
    sizes = Counter({44: 300, 27: 300, 29: 300, 6: 10, 50: 7, 33: 41, 34: 41})
    used = lambda plan: sum(k for _, k in plan)
    assert packing.lower_bound(sizes, 100) <= used(packing.bin_completion(sizes, 100)[0]) <= used(packing.best_fit(sizes, 100))
    assert packing.bin_completion({}, 100) == ([], "lower bound") and used(packing.bin_completion({100: 10**9}, 100)[0]) == 10**9


def test_search_says_how_it_ended():
    hard = Counter({51: 3, 34: 5, 33: 4, 27: 5, 26: 4, 18: 3})
    ends = {packing.bin_completion(hard, 100, n)[1] for n in (0, 10**6)} | {packing.bin_completion({60: 3}, 100)[1]}
    assert "lower bound" in ends and ends <= {"lower bound", "exhausted", "limit"}


@pytest.mark.parametrize("seed", range(6))
def test_completions_are_the_undominated_fillings(seed):
    """Against the definition, over all subsets; with more items in a filling than could be tried one by one."""
    rng = random.Random(seed)
    counts = Counter(rng.randrange(5, 40) for _ in range(9))
    sizes, room = sorted(counts, reverse=True), 70
    fillings = {tuple(sorted(x, reverse=True)) for k in range(1, 10) for x in combinations(sorted(counts.elements()), k) if room - 12 <= sum(x) <= room}

    def dominated(x):
        for k in range(1, len(x) + 1):
            for part in combinations(x, k):
                for s in counts:
                    if counts[s] > x.count(s) and sum(part) <= s <= sum(part) + room - sum(x) and (k > 1 or s > sum(part)):
                        return True
        return False

    want = {x for x in fillings if not dominated(x)}
    got = {tuple(sorted(x, reverse=True)) for x in packing.completions(counts, sizes, room, 12)}
    assert got <= fillings and {x for x in got if len(x) > 2} == {x for x in want if len(x) > 2} or counts.get(room)
    many = Counter({3: 40, 7: 40, 11: 2})
    assert all(sum(x) <= 200 for x in packing.completions(many, [11, 7, 3], 200, 200))


def docs(spark, n=120):
    rng = random.Random(3)
    words = "alpha beta gamma delta $x^2$ \\cite{a} mixture".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))), f"s{min(3, i % 7)}", "clash") for i in range(n)]
    rows += [(900, None, "s1", ""), (901, "", "s1", ""), (902, "word " * 20_000, "s1", ""), (5, rows[5][1], "s5", ""), (903, "a b c", None, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, container string")


def test_packing(spark):
    d = docs(spark)
    got = packing.pack(d, capacity=512).collect()
    count = lambda t: len(_encoding(RANKS).encode_ordinary(t)) if t else 0
    want = Counter()
    for r in d.collect():
        n = count(r["text"])
        want.update((r["doc_id"], p, min(512, n - p * 512)) for p in range(max(1, -(-n // 512))))
    assert Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in got) == want
    fill = Counter()
    for r in got:
        fill[r["container"]] += r["n_tokens"]
    sizes = Counter(r["n_tokens"] for r in got if r["n_tokens"])
    assert max(fill.values()) <= 512 and len(fill) <= 1.02 * packing.lower_bound(sizes, 512) + 1
    assert packing.pack(d.limit(0)).collect() == []
    assert [r["container"] for r in packing.pack(d.filter("text is null or text = ''")).collect()] == [0, 0]


def test_packing_in_runs(spark, monkeypatch):
    """Ranks do not depend on how a size is cut into runs."""
    monkeypatch.setattr(packing, "RUN", 7)
    d = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
    fill = Counter(r["container"] for r in packing.pack(d, capacity=6).collect())
    assert set(fill.values()) == {3, 1} and len(fill) == 34


def test_quotas():
    assert mixing.quotas({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1)}) == {"a": (2, 0), "b": (0, 200)}
    assert mixing.quotas({"a": 100}, {"a": (0.5, 2), "b": (0.5, 1)}) == {"a": (0, 0), "b": (0, 0)}
    assert mixing.quotas({"a": 100}, {}) == {}


def test_mix(spark):
    d = docs(spark, 400).filter("doc_id < 900")
    targets = spark.createDataFrame([("s0", 0.2, 3), ("s1", 0.1, 2), ("s2", 0.1, 4), ("s3", 0.6, 1), (None, 0.5, 9), ("s9", 0.0, 9)], "source string, target_share double, max_repeats int")
    uses = mixing.mix(d, targets, block=256).collect()
    per = Counter((r["doc_id"], r["source"]) for r in uses)
    most = {"s0": 3, "s1": 2, "s2": 4, "s3": 1}
    assert all(n <= most[s] for (_, s), n in per.items())
    total = Counter()
    for r in uses:
        total[r["source"]] += r["n_tokens"]
    whole = sum(total.values())
    share = {"s0": 0.2, "s1": 0.1, "s2": 0.1, "s3": 0.6}
    assert all(abs(total[s] / whole - w) < 0.01 for s, w in share.items())
    assert len({(r["doc_id"], r["source"], r["pass_no"]) for r in uses}) == len(uses)
    # every prefix of the schedule is mixed, too
    half = Counter()
    for r in uses:
        if r["slot"] <= max(x["slot"] for x in uses) // 2:
            half[r["source"]] += r["n_tokens"]
    assert all(abs(half[s] / sum(half.values()) - w) < 0.05 for s, w in share.items())
    # a source that lacks makes the shares impossible
    lacking = targets.unionByName(spark.createDataFrame([("s8", 0.1, 1)], targets.schema))
    assert mixing.mix(d, lacking).collect() == [] and mixing.mix(d.limit(0), targets).collect() == []


@pytest.mark.parametrize(("run", "slots"), [(3, 2), (7, 10**6)])
def test_mix_in_runs(spark, monkeypatch, run, slots):
    """The schedule's shares hold however sources are cut into runs and slots into chunks; chunks change nothing at all."""
    d = docs(spark, 150).filter("doc_id < 900")
    targets = spark.createDataFrame([("s0", 0.3, 3), ("s1", 0.3, 3), ("s3", 0.4, 1)], "source string, target_share double, max_repeats int")
    want = {tuple(r) for r in mixing.mix(d, targets, block=256).collect()}
    monkeypatch.setattr(mixing, "SLOTS", slots)
    assert {tuple(r) for r in mixing.mix(d, targets, block=256).collect()} == want
    monkeypatch.setattr(mixing, "RUN", run)
    assert {tuple(r) for r in mixing.mix(d, targets, block=256).collect()} == want


BODY = "The {0} of the sample was measured for $x_{{{1}}}$ and {1} runs. It was shown that every {0} follows a law, i.e. one that we discuss below. "


def texts(n, seed, cut):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = "".join(BODY.format(rng.choice(["kernel", "graph", "orbit", "layer"]), rng.randrange(99)) for _ in range(rng.randrange(3, 12)))
        if i % 3 == 0:
            t = "\\documentclass{a}\n\\def\\done{\\end{document}}\n\\begin{document}\n" + body + "\n\\begin{equation}\nx = 1\n\\end{equation}\n" + rng.choice(["\\done", "\\end{document}", "\\input{rest}"])
        else:
            t = body.strip() + rng.choice(["", "\n% not done yet and", "\n\n\\qed", "\n\\begin{itemize}\n\\item One.\n\\end{itemize}"])
        if cut(i):
            at = rng.randrange(60, max(61, len(t) - 30))
            t = t[:at].rstrip(" .") + rng.choice(["", " [...]", ""])
        out.append((i, t, f"s{i % 4}", "clash"))
    return out


def test_truncation_held_out(spark):
    cut = lambda i: i % 5 == 4
    rows = texts(600, 1, cut)
    schema = "doc_id bigint, text string, source string, score string"
    extra = [(9000, None, "s0", ""), (9001, "", None, ""), (9002, "\\input{x}", None, ""), (9003, "$" * 30_000 + "a" * 50_000, "s1", "")]
    got = {r["doc_id"]: r["truncated"] for r in truncation.truncation_scores(spark.createDataFrame(rows + extra, schema)).collect()}
    truth = {r[0]: cut(r[0]) for r in rows}
    hit = sum(got[i] and truth[i] for i in truth)
    assert hit / sum(truth.values()) > 0.9 and hit / sum(got[i] for i in truth) > 0.9
    assert got[9000] is False and got[9001] is False and len(got) == len(rows) + 4
    assert truncation.truncation_scores(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize(
    ("text", "open_"),
    [
        ("\\documentclass{a}\\begin{document}x\\end{document}", "closed"), ("\\documentclass{a}\\begin{document}x.", True), ("\\documentclass{a}\\begin{document}x\\input{y}", False),
        ("\\documentclass{a}\\def\\e{\\end{document}}\\begin{document}x\\e", "closed"), ("A. % and $x {", False), ("A $x", True), ("A \\% $x", True), ("A \\\\% $x", False),
        ("\\begin{a}x.\\end{a}", False), ("\\begin{a}x.", True), ("A {b", True), ("A \\{b", False), ("A $$b\n\nc", True), ("A $b\n\nc", False), ("A \\[b\n\nc", True), ("A \\(b\n \nc", False),
        ("\\be x", True), ("\\be x \\ee", False), ("\\beta x", False), ("\\iffalse $ \\fi x", False), ("", False),
    ],
)
def test_structure(text, open_):
    f, _, _ = truncation.closing(text, {"be": ("begin", "equation"), "ee": ("end", "equation"), "b": ("begin", "x")})
    assert f == ["document closed"] if open_ == "closed" else f"unclosed {open_}" in f


def test_marks_and_lengths():
    for mark in (" [...]", "...", "…", " (...)", " [truncated]\n"):
        f, behind, last = truncation.closing("A word and" + mark, {})
        assert "mark True" in f and behind == len(mark) and last == "a"
    assert truncation.closing("A word.", {})[1] == 0
    rooms = [truncation.with_length([], "a", n, 0, 1000) for n in (1000, 998, 960, 100)] + [truncation.with_length([], "a", 100, 0, None)]
    assert len(set(map(tuple, rooms))) == 5 and truncation.with_length([], "a", 1024, 0, None) != rooms[-1]


def test_macros_come_from_preambles(spark):
    pre = "\\documentclass{a}\n\\newcommand{\\%s}{\\%s{%s}}\n\\begin{document}\n"
    rows = [(pre % ("be", "begin", "equation"),)] * 2 + [(pre % ("be", "begin", "eqnarray"),), (pre % ("ee", "end", "equation"),), ("\\newcommand{\\zz}{\\begin{q}}",), (None,), ("",)]
    d = spark.createDataFrame(rows, "text string")
    assert truncation.environment_macros(d, "text") == {"be": ("begin", "equation"), "ee": ("end", "equation")}
    assert truncation.environment_macros(d, "text", 1) == {"be": ("begin", "equation")} and truncation.environment_macros(d.limit(0), "text") == {}
