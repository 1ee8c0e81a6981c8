"""Each operator against brute force or held-out truth, with nulls, empty and long texts, ties, repeats, empty tables."""

import collections
import glob
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import ann, decontaminate, language, mixing, quality, queries, quotes, simhash, suffixes, toxicity
from inkwell.llm.shared import Scratch, crc_mod

from ..conftest import SMALL, same

WORDS = [a + b for a in "ba be bi bo bu da de di do du fa fe".split() for b in "n r s t l".split()]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, nulls, empty and long texts, repeated rows, a clashing column."""
    base = [prose(120, i) for i in range(12)]
    passage = prose(70, 99)
    data = [(i, t) for i, t in enumerate(base)]
    data += [(20, base[0]), (21, base[0].upper()), (22, base[1].replace(base[1].split()[5], "other", 1)), (23, "\t\n "), (24, None), (25, ""), (25, ""), (26, "two words"), (27, "two words"), (None, base[2]), (28, prose(30_000, 7))]
    data += [(30 + i, prose(25, 100 + i) + " " + passage + " " + prose(25, 200 + i)) for i in range(6)]
    return spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, size string")


def local(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("radius", [1, 3])
def test_covering_codes_miss_no_pair(radius):
    masks = [m & (1 << 64) - 1 for m in simhash.masks(radius, 0)]
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(1)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not d & m for m in masks)


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in nodes:
        for b in nodes:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    fp = {(i, t): simhash.fingerprint(t) for i, t in local(docs)}
    assert collections.Counter((r["doc_id"], r["fingerprint"]) for r in got) == collections.Counter((i, f"{fp[i, t]:016x}") for i, t in local(docs))
    comp = brute_components(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), f in fp.items():
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    assert all(r["component_id"] == least.get(comp[int(r["fingerprint"], 16)]) for r in got)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprint_by_definition():
    from xxhash import xxh64_intdigest

    t = "The cat sat on the CAT sat on\tthe mat"
    w = t.lower().split()
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("a b") == xxh64_intdigest(b"a b", 42) and simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


def test_large_buckets_are_dealt_out_again(spark, scratch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), scratch, 3, block=100).collect()
    pairs = {frozenset((r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1)) for r in links}
    assert all((a ^ b).bit_count() <= 3 for a, b in map(tuple, pairs))
    assert brute_components(fps, lambda a, b: frozenset((a, b)) in pairs) == brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)


def test_similar_groups(spark, scratch):
    base = [prose(200, i) for i in range(8)]
    near = [" ".join("new" if k in (50, 120) else w for k, w in enumerate(t.split())) for t in base]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(base + near)] + [(99, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["first_id"] for r in simhash.similar_groups(df, scratch).collect()}
    assert got == {i: i % 8 for i in range(16)} | {99: 99}


def test_similar_groups_are_exact(spark, scratch):
    """Short and long pairs just below 0.8 stay apart, those at 0.8 or just above are linked."""
    data, want, rng = [], {}, random.Random(5)
    fresh = (f"w{i}" for i in range(10**6))
    take = lambda n: [next(fresh) for _ in range(n)]
    for k in range(30):
        for n in (4, 5, 6):  # one word appended: J = n / (n + 1)
            t = take(n + 4)
            data += [(len(data), " ".join(t)), (len(data) + 1, " ".join(t + take(1)))]
            want[len(data) - 1] = len(data) - 2
        for n in (6, 7, 8):  # the last word changed: J = (n - 1) / (n + 1)
            t = take(n + 4)
            data += [(len(data), " ".join(t)), (len(data) + 1, " ".join(t[:-1] + take(1)))]
            want[len(data) - 1] = len(data) - 1
        for changed, linked in ((112, False), (124, False), (80, True)):  # J = (1000 - m) / (1000 + m), m shingles changed at the end
            t = take(1004)
            data += [(len(data), " ".join(t)), (len(data) + 1, " ".join(t[: 1004 - changed] + take(changed)))]
            want[len(data) - 1] = len(data) - 2 if linked else len(data) - 1
    rng.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["first_id"] for r in simhash.similar_groups(df, scratch).collect()}
    assert all(got[i] == i for i, _ in data if want.get(i, i) == i)
    missed = sum(got[i] != j for i, j in want.items())  # the bands miss one in 500 at 0.8
    assert missed <= 2


def test_groups_in_blocks(spark, scratch, monkeypatch):
    """Cutting a group into blocks changes nothing."""
    base = prose(60, 1).split()
    data = [(i, " ".join(base[: 60 - i % 7] + [f"x{i}"])) for i in range(60)] + [(100, ""), (101, None), (102, " ")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    whole = {r["doc_id"]: r["first_id"] for r in simhash.similar_groups(df, scratch).collect()}
    monkeypatch.setattr(simhash, "SHINGLES", 500)
    assert {r["doc_id"]: r["first_id"] for r in simhash.similar_groups(df, scratch).collect()} == whole
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in data}
    alike = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert whole == brute_components(list(sets), alike)


def test_quotes(spark, scratch):
    data = [
        (1, 0, "user", "Hello there, how are you?\nSecond line here"), (1, 1, "assistant", "On Monday Bob wrote:\n> Hello there, how are YOU?\n\nFine thanks."),
        (1, 2, "user", "> > Hello there, how are you?\n> Fine thanks.\nGood to know"), (1, 3, "assistant", "> second line here\nBack to line two"), (1, 4, "user", "plain"),
        (1, 900, "user", "> plain\nlate"), (None, None, None, None), (2, 0, "user", "> Hello there, how are you?\nno original"), (2, 0, "user", "> Hello there, how are you?\nno original"),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("branch", F.lit("clash"))
    got = {(r["conv_id"], r["turn"], r["branch"], r["position"]): r for r in quotes.link_conversations(df, scratch).collect()}
    assert len(got) == len(data)
    one = {k[1]: (r["parent_turn"], r["by_quote"], r["quote_levels"], k[2], k[3], r["reply"]) for k, r in got.items() if k[0] == 1}
    assert one == {
        0: (None, False, 0, 0, 0, "Hello there, how are you?\nSecond line here"), 1: (0, True, 1, 0, 1, "Fine thanks."), 2: (1, True, 2, 0, 2, "Good to know"),
        3: (0, True, 1, 1, 0, "Back to line two"), 4: (3, False, 0, 1, 1, "plain"), 900: (4, True, 1, 1, 2, "late"),
    }
    assert quotes.link_conversations(df.limit(0), scratch).count() == 0


def test_reply_order_is_the_trees(spark, scratch, monkeypatch):
    """Random trees, long chains, a turn with many messages and equal rows, against a walk of the tree."""
    monkeypatch.setattr(quotes, "SPAN", 8)
    rng, data, up = random.Random(6), [], {}
    for c, n in ((1, 40), (2, 3), (3, 1), (4, 70), (5, 25)):
        for t in range(n):
            p = rng.randrange(t) if t and rng.random() < (0.7 if c != 5 else 0) else None
            data.append((c, t, "user", (f"> line {c} {p} one\n" if p is not None else "") + f"line {c} {t} one"))
            up[c, t] = p if p is not None else t - 1 if t else None
    many = [(9, None, "user", f"m{i % 20}") for i in range(60)]
    linked = quotes.link_conversations(spark.createDataFrame(data + many, "conv_id long, turn long, role string, text string"), scratch)
    got = linked.collect()
    assert len(got) == len(data) + 60 and {r["place"] for r in got if r["conv_id"] == 9} == set(range(60))
    kids = collections.defaultdict(list)
    for (c, t), p in sorted(up.items()):
        kids[c, p].append(t)
    want = {}
    for c in {c for c, _ in up}:
        stack, place, thread, before = [(0, 0)], 0, 0, -1
        while stack:
            t, depth = stack.pop()
            thread += depth <= before
            want[c, t] = (place, depth, thread)
            place, before = place + 1, depth
            stack += [(k, depth + 1) for k in reversed(kids[c, t])]
    assert {(r["conv_id"], r["turn"]): (r["place"], r["depth"], r["thread"]) for r in got if r["conv_id"] != 9} == want
    assert [t for _, t in sorted((v[0], k[1]) for k, v in want.items() if k[0] == 1)] != list(range(40))
    texts = {r["conv_id"]: r for r in quotes.dialogues(linked, 1000).collect()}
    assert texts[1]["messages"] == 40 and texts[1]["chat"].count("<|end|>") == 40 and ">line" not in texts[1]["chat"]
    assert quotes.dialogues(linked, 8).filter("messages > 8").count() == 0


@pytest.mark.parametrize("hot, few", [(suffixes.HOT, suffixes.FEW), (2, suffixes.FEW), (2, 0)])
def test_suffixes(spark, docs, scratch, monkeypatch, hot, few):
    monkeypatch.setattr(suffixes, "FEW", few)
    got = collections.defaultdict(set)
    for r in suffixes.repeated_spans(docs, scratch, hot=hot).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    seen, want = set(), {}
    once = {(i, t) for i, t in local(docs)}
    for i, t in sorted(once, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        w, marked = (t or "").lower().split(), set()
        for k in range(len(w) - 49):
            run = tuple(w[k : k + 50])
            marked |= set(range(k, k + 50)) if run in seen else set()
            seen.add(run)
        if marked:
            want[i] = marked
    assert got == want and len(want) >= 7


def test_cut_texts(spark, docs, scratch):
    clash = docs.withColumns({"uid": F.lit("u"), "spans": F.lit("s"), "_uid": F.lit(1)})
    cut = suffixes.without_repeats(clash, scratch)
    assert cut.columns == clash.columns and {(r["uid"], r["spans"], r["_uid"]) for r in cut.collect()} == {("u", "s", 1)}
    out = local(cut)
    kept = dict(out)
    assert kept[0] == dict(local(docs))[0] and 20 not in kept and len(kept[33].split()) == 50 and 24 in kept
    assert suffixes.without_repeats(docs.limit(0), scratch).count() == 0


@pytest.mark.parametrize("kind", ["int", "string"])
def test_cut_texts_whatever_the_type_of_id(spark, docs, scratch, kind):
    want = sorted((str(i), t) for i, t in local(suffixes.without_repeats(docs, scratch)))
    typed = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
    assert sorted((str(i), t) for i, t in local(suffixes.without_repeats(typed, scratch))) == want


def test_a_common_passage_takes_a_row_a_slice_and_bucket(spark, scratch):
    common = " ".join(f"c{k}" for k in range(150))
    d = spark.createDataFrame([(i, f"own{i} {common} end{i}") for i in range(400)], "doc_id long, text string").coalesce(2)
    got = suffixes.repeated_spans(d, scratch).collect()
    assert sorted(tuple(r) for r in got) == [(i, 1, 151, 150, 0) for i in range(1, 400)]
    context = next(c for c in glob.glob(f"{scratch.base.removeprefix('file:')}/context-*"))
    assert spark.read.parquet(context).count() <= 4


def test_minimisers_cover_every_window():
    words = np.random.default_rng(0).integers(0, 50, 5000).astype(np.uint64)
    at, _ = suffixes.minimisers(words, np.array([0, 5000]))
    assert all(((at >= k) & (at + suffixes.GRAM <= k + 50)).any() for k in range(4951))


def test_language(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "123 !!", None), (None, "the and of", None)], "doc_id long, text string, lang string")
    m = language.learn(d.unionByName(odd), crc_mod(F.col("doc_id"), 4) != 2)
    got = language.identify(d.unionByName(odd).withColumn("lang_pred", F.lit(1)), m).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] >= 0 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in got if (r["doc_id"] or 0) < 0} == {-1: ("und", 0.0), -2: ("und", 0.0), -3: ("und", 0.0)}
    assert all(0 <= r["lang_score"] <= 1 for r in got)
    none = language.learn(d.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(d, none).collect()} == {"und"}


def plain_grams(text):
    """The four-byte n-grams of a text, one by one."""
    out, b = [], b" " + (text or "").lower().encode()
    for c in b:
        c = c if c >= 128 or 97 <= c <= 122 else 32
        if c != 32 or not out or out[-1] != 32:
            out.append(c)
    return [bytes(out[i : i + 4]) for i in range(len(out) - 3)]


def test_language_against_exact_sets(spark):
    """The filter's corrected shares and winners are those of plain sets of n-grams."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    allowed = crc_mod(F.col("doc_id"), 4) != 2
    counts = {}
    for r in d.filter(allowed).filter("lang is not null").collect():
        counts.setdefault(r["lang"], collections.Counter()).update(plain_grams(r["text"]))
    share = {k: {g: n / c.total() for g, n in c.items()} for k, c in counts.items()}
    most = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    sets = {k: {g for g, v in s.items() if v >= 1e-5 and v >= 0.1 * most[g]} for k, s in share.items()}
    m = language.learn(d, allowed)
    assert m.languages == sorted(sets)
    texts = [r["text"] for r in d.orderBy("doc_id").collect()] + [" ", "a", "x" * 100_000]
    got, same = m.shares(pa.array(texts, pa.string())), 0
    for text, row in zip(texts, got):
        grams = plain_grams(text)
        exact = np.array([sum(g in sets[k] for g in grams) / max(1, len(grams)) for k in m.languages])
        assert np.abs(row - exact).max() < 0.03
        top = np.sort(exact)[::-1]
        same += row.argmax() == exact.argmax() or top[0] - top[1] < 0.03
    assert same == len(texts)


def test_texts_without_known_grams_get_a_language(spark):
    learned = spark.createDataFrame([(i, prose(40, i), "xx" if i % 3 else "aa") for i in range(60)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "A."), (2, "Щит и меч"), (3, "qqqqqq"), (4, "7 !"), (5, None), (6, ""), (7, "é")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language.identify(odd, language.learn(learned, F.lit(True))).collect()}
    assert {i for i, (name, s) in got.items() if name == "und" and s == 0} == {4, 5, 6}
    assert all(got[i] == ("xx", 1 / 3) for i in (1, 2, 3, 7))


def test_tiling_catches_reordered_passages():
    a, b = prose(12, 1), prose(12, 2)
    items = decontaminate.Items([5, 6], [f"{a} {b}", "too short"], 5)
    import pyarrow as pa

    leaks = items.leaks(pa.array([f"x y {b} filler words {a} z", f"{a} only half", prose(40, 3), None, ""]), 0.6)
    assert leaks[0] == [{"item_id": 5, "coverage": 1.0, "tiles": 2}] and leaks[1:] == [[], [], [], []]


def test_tiles_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        p, t = ([rng.choice("abc") for _ in range(n)] for n in (14, 25))
        seeds = [(i, j) for i in range(len(p) - 2) for j in range(len(t) - 2) if p[i : i + 3] == t[j : j + 3]]
        got = decontaminate.tile(seeds, 3)
        used_i, used_j, want = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i in range(len(p)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and i + n not in used_i and j + n not in used_j:
                        n += 1
                    best = max(best, (n, -i, -j))
            n, i, j = best[0], -best[1], -best[2]
            if n < 3:
                break
            want.append((i, j, n))
            used_i |= set(range(i, i + n))
            used_j |= set(range(j, j + n))
        assert got == sorted(want)


@pytest.mark.parametrize("text, item, covered", [("na ", "na ", 1.0), ("a b ", "a b ", 1.0), ("la na na ", "na la na na ", 0.625)])
def test_a_megabyte_of_repetition(text, item, covered):
    import pyarrow as pa

    items = decontaminate.Items([7], [item * (320 // len(item.split()))], 5)
    found = items.leaks(pa.array([text * (1_000_000 // len(text)), "", None], pa.large_string()), 0.5)
    assert [x["coverage"] for x in found[0]] == [pytest.approx(covered)] and found[1:] == [[], []]


def test_both_ways_of_decontamination_agree(spark, docs):
    items = spark.createDataFrame([(1, prose(120, 3)), (1, prose(120, 3)), (2, None), (3, ""), (4, prose(20, 5)), (None, prose(70, 99))], "item_id long, text string")
    flat = lambda df: collections.Counter((r["doc_id"], r["text"], tuple(sorted((str(x["item_id"]), x["coverage"], x["tiles"]) for x in r["leaks"]))) for r in df.collect())
    a, b = decontaminate.leaks(docs, items), decontaminate.leaks(docs, items, bound=10)
    assert flat(a) == flat(b) and sum(len(r["leaks"]) > 0 for r in a.collect()) == 8
    assert decontaminate.leaks(docs, items.limit(0)).filter("size(leaks) > 0").count() == 0


def test_mixing_matches_sql(spark, duck):
    same(queries.op7_mixing(spark, SMALL), duck, queries.OP7_SQL)


def test_mixing_cases(spark, scratch):
    data = [(i, f"s{i % 3}" if i % 4 else None, "w " * (i % 9)) for i in range(400)] + [(5, "s1", "a b"), (5, "s1", "a b"), (None, "s2", None), (1000, "only empty", "")]
    df = spark.createDataFrame(data, "doc_id long, source string, text string").withColumn("taken", F.lit("clash"))
    got = mixing.mix(df, scratch).toPandas()
    assert len(got) == len(data) and (got.taken <= 2 * got["size"]).all()
    by = got.fillna({"source": "none"}).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - 1.5 * got["size"].sum()) < 1e-6 and (by.target <= 2 * by["size"]).all() and ((by.taken - by.target).abs() <= 8).all()
    again = mixing.mix(df.repartition(5), scratch).toPandas()
    assert sorted(map(tuple, got[["doc_id", "taken"]].fillna(-1).to_numpy())) == sorted(map(tuple, again[["doc_id", "taken"]].fillna(-1).to_numpy()))
    assert mixing.mix(df.limit(0), scratch).count() == 0


def test_mixing_equal_rows_and_clashing_names(spark, scratch):
    """Null ids, equal rows: targets are met to a document; columns with the operator's own names pass through."""
    data = [(None, s, f"{i % 3 if s == 'a' else i} " + "w " * 7) for s in "abc" for i in range(1000)]
    names = ["key", "s", "threshold", "passes", "extra", "row", "kept", "n", "j", "last", "prefix"]
    df = spark.createDataFrame(data, "doc_id long, source string, text string").withColumns({c: F.lit(c) for c in names})
    got = mixing.mix(df, scratch).toPandas()
    by = got.groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert (abs(by.taken - by.target) <= 8).all() and list(by.source_size) == [8000] * 3 and all((got[c] == c).all() for c in names)
    again = mixing.mix(df.repartition(7), scratch).toPandas()
    assert collections.Counter(zip(got.source, got.taken)) == collections.Counter(zip(again.source, again.taken))


def toxic_set(spark):
    rng = random.Random(0)
    data, labels = [], []
    for i in range(240):
        t = prose(60, i).split()
        y = i % 3 == 0
        if y:
            t.insert(rng.randrange(60), rng.choice(["zorgface", "blimpkin"]))
        data.append((i, " ".join(t)))
        labels.append((i, int(y), int(y)))
    odd = [(900, None), (901, ""), (902, prose(30, 1) + " z.o.r.g.f.a.c.e " + prose(30, 2)), (903, "b l i m p k i n " + prose(20, 3)), (904, prose(60, 4) + " zorgxface"), (905, prose(60, 5))]
    return spark.createDataFrame(data + odd, "doc_id long, text string"), spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_set(spark)
    m = toxicity.fit(docs, labels, allowed=crc_mod(F.col("doc_id"), 4) != 2)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs.withColumn("toxicity", F.lit("clash")), m).collect()}
    assert all((got[i] >= 0.3) == (i % 3 == 0) for i in range(240))
    assert [got[i] >= 0.3 for i in range(900, 906)] == [False, False, True, True, True, False]
    assert toxicity.fit(docs, labels.limit(0)) == 0.5
    assert {r["toxicity"] for r in toxicity.score(docs, 0.5).collect()} == {0.5}


def test_kernel_by_definition():
    def weights(word):
        s, out = f" {word} ", collections.Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    for m in range(k + 1, min(len(s), i + 6)):
                        out[s[i] + s[j] + s[k] + s[m]] += toxicity.DECAY ** (m - i - 3)
        return out

    a, b = weights("idiot"), weights("idxiot")
    occurrences = lambda n: sum(max(0, n - p[-1]) * toxicity.DECAY ** (2 * (p[-1] - 3)) for p in toxicity.PATTERNS)
    want = sum(a[u] * b[u] for u in a) / math.sqrt(occurrences(7) * occurrences(8))
    assert abs(toxicity.Landmarks(["idiot"]).kernel(["idxiot"])[0, 0] - want) < 1e-9


def brute_neighbours(x, ids, q, k):
    score = x @ x[q]
    order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-score[i], ids[i]))
    return [ids[i] for i in order[:k]]


def test_neighbours(spark, scratch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[100:160] = x[100]  # copies
    data = [(i, x[i].tolist()) for i in range(600)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [1.0]), (1004, [None] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0, scratch).toPandas()
    hit = 0
    for q in range(0, 600, 20):
        g = got[got.query_id == q].sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id)
        hit += len(set(g.vec_id) & set(brute_neighbours(x.astype(float), range(600), q, 20)))
        assert np.allclose(g.score, x[g.vec_id].astype(float) @ x[q].astype(float), atol=1e-12)
    assert hit / 600 >= 0.9
    first = got[got.query_id == 100].sort_values("rank")
    assert list(first.vec_id) == list(range(101, 121))
    few = ann.neighbours(df.filter("vec_id in (0, 1, 2, 1000)"), F.col("vec_id") % 20 == 0, scratch).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert ann.neighbours(df.limit(0), F.lit(True), scratch).count() == 0


def test_repeated_queries_and_other_dimensions(spark, scratch):
    """A query row that occurs twice has its neighbours once; vectors are searched among those of their dimension."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(60, 8)), rng.normal(size=(30, 5))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] + [(100 + i, v.tolist()) for i, v in enumerate(y)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("rid", F.lit("clash"))
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0, scratch, epsilon=9.0, recall=1.0).toPandas()
    for q, (z, base) in {0: (x, 0), 20: (x, 0), 40: (x, 0), 100: (y, 100), 120: (y, 100)}.items():
        g = got[got.query_id == q].sort_values("rank")
        assert [v - base for v in g.vec_id] == brute_neighbours(z, range(len(z)), q - base, 20)
    assert set(got.query_id) == {0, 20, 40, 100, 120}


def test_another_vector_of_the_same_id_is_a_candidate(spark, scratch):
    x = np.random.default_rng(8).normal(size=(30, 6))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, (x[0] * 2).tolist()), (20, (-x[20]).tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0, scratch, epsilon=9.0, recall=1.0).toPandas()
    rows = [(i, np.array(v)) for i, v in data]
    want = []
    for q, (i, v) in enumerate(rows):
        if i % 20 == 0:
            near = sorted(((-(w @ v), j) for n, (j, w) in enumerate(rows) if n != q))[:20]
            want += [(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for _, r in got.iterrows()) == sorted(want)


def test_recall_with_a_sample_bounded_in_bytes(spark, scratch, monkeypatch):
    x = np.random.default_rng(9).normal(size=(4_000, 32))
    monkeypatch.setattr(ann, "SAMPLE_BYTES", 8 * 32 * 400)  # 400 vectors, hence 10 lists
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.neighbours(df, F.col("vec_id") % 80 == 0, scratch).toPandas()
    hit = [len(set(g.vec_id) & set(brute_neighbours(x, range(4_000), q, 20))) / 20 for q, g in got.groupby("query_id")]
    assert len(hit) == 50 and np.mean(hit) >= 0.9


def test_recall_with_many_lists(spark, scratch):
    """Lists to visit are measured on vectors that the centroids don't know, so few vectors a list cost no recall."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12_000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.neighbours(df, F.col("vec_id") % 120 == 0, scratch, lists=700, sample=1500).toPandas()
    hit = [len(set(g.vec_id) & set(brute_neighbours(x, range(12_000), q, 20))) / 20 for q, g in got.groupby("query_id")]
    assert len(hit) == 100 and np.mean(hit) >= 0.9


def test_recall_on_the_table(spark):
    got = queries.op9_ann(spark, SMALL).toPandas()
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(list(e.embedding)).astype(float), list(e.vec_id)
    hit = [len(set(got[got.query_id == i].vec_id) & set(brute_neighbours(x, ids, k, 20))) / 20 for k, i in enumerate(ids) if i % 20 == 0]
    assert np.mean(hit) >= 0.9


def test_quality(spark):
    rng = random.Random(1)
    junk = lambda i: " ".join(w.upper() + "!!" for w in prose(60, i).split()) if i % 2 else " ".join(rng.choice(["$$$", "###", "|"]) for _ in range(60))
    data = [(i, prose(60, i) + "." if i % 3 else junk(i)) for i in range(300)]
    docs = spark.createDataFrame(data + [(900, None), (901, "")], "doc_id long, text string").withColumn("quality_score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(2, None)], "doc_id long, quality int")
    m = quality.fit(docs, labels, allowed=crc_mod(F.col("doc_id"), 5) != 0)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, m).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 3 > 0) for i in held]) > 0.95 and all(0 <= s <= 1 for s in got.values())
    assert quality.fit(docs, labels.limit(0)) == 0.5


def test_machine_by_definition():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    m = quality.FactorisationMachine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.FACTORS)))
    r, f, v = quality.features(pa.array(["a few words here", None]))
    got = m.margin(r, f, v, 2)
    for row in range(2):
        i, x = f[r == row], v[r == row]
        pairs = sum(x[a] * x[b] * m.v[i[a]] @ m.v[i[b]] for a in range(len(i)) for b in range(a))
        assert abs(got[row] - (0.3 + m.w[i] @ x + pairs)) < 1e-9


def test_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(queries.oracle_sql()) <= set(names)


def _toxic_texts(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    return docs, labels


def _kernel(s, t):
    """k(s, t) by its definition, over strings."""

    def weights(w):
        w, out = f" {w} ", collections.Counter()
        for i in range(len(w)):
            for p in toxicity.PATTERNS:
                if i + p[-1] < len(w):
                    out["".join(w[i + k] for k in p)] += toxicity.DECAY ** (p[-1] - 3)
        return out, sum(max(0, len(w) - p[-1]) * toxicity.DECAY ** (2 * (p[-1] - 3)) for p in toxicity.PATTERNS) ** 0.5

    (f, a), (g, b) = weights(s), weights(t)
    return sum(v * g[u] for u, v in f.items()) / (a * b) if a and b else 0.0


def test_scores_by_definition():
    """A text's score from kernels with every landmark, segment by segment."""
    near, weight, bias = toxicity.Landmarks(["blimpkin", "zorgface", "window"]), np.array([2.0, 1.5, -1.0]), -0.4
    table = np.zeros(toxicity.TABLE)
    table[near.used] = near.rows.T @ weight
    m = toxicity.KernelMachine(table, bias, (3.0, -1.0))
    for text, words in [("You BLIMPkin! a zorg-face.", ["you", "blimpkin", "a", "zorgface"]), ("z o r g the window", ["zorg", "the", "window"]), ("such blixmpkins", ["such", "blixmpkins"])]:
        margin = sorted((sum(x * _kernel(w, k) for x, k in zip(weight, ["blimpkin", "zorgface", "window"])) + bias for w in words), reverse=True)
        want = margin[0] + (0.5 * max(0, margin[1]) if margin[0] > 0 else 0)
        assert abs(m.scores([text])[0] - 1 / (1 + np.exp(-(3 * want - 1)))) < 1e-6


def test_toxic_sentences():
    """Sentences are labelled, equal ones of copies once; a toxic text where nothing stands out labels none."""
    texts = ["One fine day. You zorgface here.", "One fine day. You zorgface here.", "Oh zorgface. A blimpkin", "Nothing at all", *[f"word{i} here" for i in range(20)]]
    y = np.array([1.0] * 4 + [0.0] * 20)
    words = toxicity.Vocabulary(texts)
    strong = {"zorgface": 5.0, "blimpkin": 4.0, "here": 0.5}
    margin = np.array([strong.get(w, 0.0) for w in words.texts(range(len(words.size)))])
    segment, count = toxicity.toxic_sentences(words, y, margin)
    assert list(zip(words.texts(segment), count)) == [("zorgface", 2), ("blimpkin", 1)]


def test_phrases_of_innocent_words_are_found(spark):
    """Toxic texts hold two words side by side, clean ones the same words apart."""
    rng = random.Random(2)
    texts = []
    for i in range(400):
        w = prose(30, 900 + i).split()
        k = rng.randint(3, 25)
        w[k : k + 1] = ["green", "goblin"] if i % 2 else ["green"]
        texts.append((" ".join(w if i % 2 else [*w, "and", "then", "goblin", "went"]), i % 2))
    docs, labels = _toxic_texts(spark, texts)
    m = toxicity.fit(docs, labels, allowed=F.col("doc_id") < 300)
    got = {r["doc_id"]: r["toxicity"] >= 0.3 for r in toxicity.score(docs, m).collect()}
    assert m.pairs and all(got[i] == bool(y) for i, (_, y) in enumerate(texts) if i >= 300)


def test_inserted_letters_do_not_hide_an_insult(spark):
    texts = [(f"{prose(20, i)}. You {['', 'really '][i % 2]}{prose(1, i)} scum {prose(1, i + 7)} {prose(5, i + 1)}" if i % 3 == 0 else prose(30, i), int(i % 3 == 0)) for i in range(600)]
    docs, labels = _toxic_texts(spark, texts)
    m = toxicity.fit(docs, labels)
    said = [prose(12, 5000 + i).split() for i in range(60)]
    inserted = [" ".join([*w[:6], "scum"[: 1 + i % 3] + "abeghioz"[i % 8] + "scum"[1 + i % 3 :], *w[6:]]) for i, w in enumerate(said)]
    assert (m.scores(inserted) >= 0.3).mean() >= 0.9 and (m.scores([" ".join(w) for w in said]) < 0.3).all()


def test_toxicity_of_odd_texts(spark):
    """Long texts, repeated rows, an empty table, clashing names."""
    texts = [(prose(25, i) + (" scum " if i % 2 else " ") + prose(5, i + 1), i % 2) for i in range(200)]
    docs, labels = _toxic_texts(spark, texts)
    m = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, prose(200_000, 3) + " scum"), (2, prose(200_000, 3)), (3, "scum"), (3, "scum"), (4, None), (None, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = toxicity.score(odd, m).collect()
    assert [r["toxicity"] >= 0.3 for r in sorted(got, key=lambda r: r["doc_id"] or 9)] == [True, False, True, True, False, False] and all(r["score"] == "clash" for r in got)
    assert toxicity.score(odd.limit(0), m).count() == 0


def _odd_documents(spark):
    """A very long text, repeated rows, nulls everywhere, and columns with the names that operators use inside."""
    long = " ".join([prose(60_000, 1), "The cat sat on the mat."])
    rows = [(1, long, 5), (2, "Plain words here.", 17), (2, "Plain words here.", 17), (None, None, None), (3, "", 0), (4, "x", None), (5, None, 3)]
    names = ["fp", "node", "uid", "grams", "h1", "sizes", "y", "f", "v", "leak", "seed", "mark"]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({c: F.lit(c) for c in names}), names


def _whole(got, names, rows=7):
    assert len(got) == rows and all(r[c] == c for r in got for c in names)
    return got


def test_odd_documents_keep_their_rows(spark, scratch):
    odd, names = _odd_documents(spark)
    texts = [(i, prose(30, i) if i % 2 else "buy!!! now $$$ 99 " * 10, i) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, n_chars long")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    machine = quality.fit(docs, labels, metadata=["n_chars"])
    scored = _whole(quality.score(odd, machine, metadata=["n_chars"]).collect(), names)
    assert all(0 <= r["quality_score"] <= 1 for r in scored) and scored[1]["quality_score"] == scored[2]["quality_score"]
    assert quality.score(odd.limit(0), machine, metadata=["n_chars"]).count() == 0 and quality.fit(docs.limit(0), labels, metadata=["n_chars"]) == 0.5
    model = language.learn(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")), F.lit(True))
    named = _whole(language.identify(odd, model).collect(), names)
    assert sorted(r["lang_pred"] == "und" for r in named) == [False] * 4 + [True] * 3
    assert language.identify(odd.limit(0), model).count() == 0
    items = spark.createDataFrame([(1, "the cat sat on the mat."), (2, None), (None, "")], "item_id long, text string")
    leaks = {(r["doc_id"], len(r["leaks"])) for r in _whole(decontaminate.leaks(odd, items).collect(), names)}
    assert leaks == {(1, 1), (2, 0), (None, 0), (3, 0), (4, 0), (5, 0)} and decontaminate.leaks(odd.limit(0), items).count() == 0
    groups = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd, scratch=scratch).collect()}
    assert groups == {(1, 1), (2, 2), (4, 4), (None, 3), (3, 3), (5, 3)} and simhash.near_duplicates(odd.limit(0), scratch=scratch).count() == 0
    assert suffixes.repeated_spans(odd, scratch).count() == 0


def test_a_scratch_is_removed(spark):
    s = Scratch(spark, "gone")
    kept = s.keep(spark.range(3), "x")
    assert kept.count() == 3
    s.remove()
    assert not s._fs(s.base).exists(s._path(s.base)) and s not in Scratch.made
