import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from loomgraph.llm import _text
from loomgraph.llm import pitman_yor as py

A = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*(text or "").translate(A).encode().split(), None]


def brute(rows):
    learn = Counter(t for d, x in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1 for t in tokens(x))
    n, v = sum(learn.values()), len(learn)
    out = []
    for d, x in rows:
        toks = tokens(x)
        base = sum(math.log10((learn[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks) if n else None
        out.append((d, len(toks), sum(learn[t] > 0 for t in toks), n, base))
    return out


def test_packing():
    for arrays in ([np.arange(5, dtype=np.uint64), np.empty(0, np.float32)], [np.array([300, 2], np.uint16), np.array([1.5]), np.array([-3], np.int64)]):
        back = py._unpack(py._pack(*arrays))
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, back, strict=True))


def alone(n, free, step):
    """Tables of free + step * k in a parent that does not change."""
    return py.Rise(np.full(n, free), step, np.ones(n), np.zeros(n), np.ones(n), 0.0)


def seatings(customers):
    """Sizes of tables of all ways to seat these customers."""
    found = [[1]]
    for _ in range(customers - 1):
        found = [s[:i] + [s[i] + 1] + s[i + 1 :] for s in found for i in range(len(s))] + [[*s, 1] for s in found]
    return found


def test_tables_match_enumerated_seatings():
    rng = np.random.default_rng(4)
    for customers, free, step, d in ((7, 0.7, 0.2, 0.6), (6, 0.1, 0.01, 0.8), (8, 3.0, 0.5, 0.4)):
        want = np.zeros(customers + 1)
        for sizes in seatings(customers):
            want[len(sizes)] += math.prod(free + step * k for k in range(len(sizes))) * math.prod(m - d for n in sizes for m in range(1, n))
        got = py.reseat(np.full(40_000, customers), alone(40_000, free, step), d, rng)
        assert np.abs(np.bincount(got, minlength=customers + 1) / len(got) - want / want.sum()).max() < 0.012


def test_tables_of_many_customers():
    """Beyond the table the weights are near those of a larger table."""
    rng = np.random.default_rng(5)
    customers = 4000
    for d in (0.1, 0.5, 0.9):
        log_s = py.stirling(d, customers)[customers, 1:]
        for free, step in ((0.5, 0.01), (100.0, 0.2), (60.0, 0.1)):
            weight = log_s + np.cumsum(np.log(free + step * np.arange(customers)))
            weight = np.exp(weight - weight.max())
            weight /= weight.sum()
            t = np.arange(1, customers + 1)
            mean = (weight * t).sum()
            got = py.reseat(np.full(300, customers), alone(300, free, step), d, rng)
            assert abs(got.mean() - mean) < 0.03 * mean + 5 * math.sqrt((weight * (t - mean) ** 2).sum() / 300), (d, free, got.mean(), mean)


def test_tables_around_the_likeliest(monkeypatch):
    """Short lists around the likeliest number give what whole lists do."""
    for d, free, step, customers in ((0.9, 5.0, 0.5, 300_000), (0.3, 400.0, 0.3, 100_000), (0.5, 2.0, 0.45, 50_000)):
        found = []
        for listed in (1 << 30, 64):
            monkeypatch.setattr(py, "LISTED", listed)
            found.append([py.reseat(np.array([customers]), alone(1, free, step), d, np.random.default_rng(k))[0] for k in range(60)])
        assert abs(np.mean(found[0]) - np.mean(found[1])) < 0.01 * np.mean(found[0]) + np.std(found[0]) * 0.5, (d, found)


def test_small_tables(spark):
    rows = [(i, f"The cat {i % 3} sat\ton the  mat  x {'w' * (i % 5)}") for i in range(60)] + [(100, None), (101, ""), (None, "THE end"), (7, "again again"), (7, "again again")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in py.score(df).collect()), key=str)
    for a, b in zip(got, sorted(brute(rows), key=str), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
    assert py.score(df.limit(0)).count() == 0
    none = [d for d in range(40) if zlib.crc32(str(d).encode()) % 5 == 1]
    alone = py.score(df.filter(df.doc_id.isin(none))).collect()
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in alone)


def test_tables_raise_the_parent():
    """The number of tables with a parent that each of their customers raises, against plain sums."""
    rng = np.random.default_rng(6)
    for others, kept in ((0, 0), (4, 2)):
        c, d2, d1, free, above, total = 6, 0.6, 0.4, 0.8, 0.05, 9.0
        n = 40_000
        rise = py.Rise(np.full(n, free), d2, np.full(n, others - d1 * kept + above), np.full(n, d1 if others == 0 else 0.0), np.full(n, total))
        want = np.zeros(c + 1)
        for sizes in seatings(c):
            up = math.prod((others + k - d1 * (kept if others else min(k, 1)) + above) / (total + k) for k in range(len(sizes)))
            want[len(sizes)] += math.prod(free + d2 * k for k in range(len(sizes))) * up * math.prod(m - d2 for s in sizes for m in range(1, s))
        got = py.reseat(np.full(n, c), rise, d2, rng)
        assert np.abs(np.bincount(got, minlength=c + 1) / n - want / want.sum()).max() < 0.012


class Box:
    def __init__(self, value):
        self.value = value


class Plain:
    """The model with every customer at a table, one removed and seated at a time."""

    def __init__(self, strength, discount, base, rng):
        self.s, self.d, self.base, self.rng = strength, discount, base, rng
        self.houses = {}

    def house(self, context):
        return self.houses.setdefault(context, [0, 0, {}])

    def prob(self, context, w):
        level = len(context)
        above = self.prob(context[:-1], w) if context else self.base
        n, t, dishes = self.house(context)
        own = dishes.get(w, ())
        s, d = self.s[level], self.d[level]
        return (sum(own) - d * len(own) + (s + d * t) * above) / (s + n)

    def add(self, context, w):
        level = len(context)
        above = self.prob(context[:-1], w) if context else self.base
        house = self.house(context)
        own = house[2].setdefault(w, [])
        s, d = self.s[level], self.d[level]
        odds = [m - d for m in own] + [(s + d * house[1]) * above]
        at = self.rng.choices(range(len(odds)), odds)[0]
        house[0] += 1
        if at < len(own):
            own[at] += 1
        else:
            own.append(1)
            house[1] += 1
            if context:
                self.add(context[:-1], w)

    def remove(self, context, w):
        house = self.house(context)
        own = house[2][w]
        at = self.rng.choices(range(len(own)), own)[0]
        own[at] -= 1
        house[0] -= 1
        if not own[at]:
            own.pop(at)
            house[1] -= 1
            if context:
                self.remove(context[:-1], w)

    def tables(self):
        out = [0, 0, 0]
        for context, (_, t, _) in self.houses.items():
            out[len(context)] += t
        return out


def corpus(seed, n=50):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(n):
        t = [rng.choice(words)]
        while len(t) < 20:
            t.append(words[(int(t[-1][1:]) * 7 + rng.choice([0, 0, 0, 1, 2, 5, 11])) % 30] if rng.random() < 0.8 else rng.choice(words))
        texts.append(" ".join(t))
    return texts


def learn(texts, held, folder, fixed, hot=((), ()), buckets=3, sweeps=(10, 100), seed=1):
    """train() and the scores without a cluster: (tables by level after each kept sweep, score of each text)."""
    kind, shards = pa.int64(), 4
    word, doc = py.text_tokens(*_text.text_bytes(pa.array(texts)))
    words = np.sort(np.array(hot[0], np.uint64))
    pairs = np.sort(np.array(hot[1], np.uint64))
    level = py.Level(*fixed, words=words, pairs=pairs)
    route = py.Route(buckets, words, pairs, np.unique(word)[::2])
    dealt = [py._dealt(b, "0-0", pa.array([], kind), block.pack()) for b, block in py._block(word, doc, np.array(held), route).deal(route)]
    up = list(py._merge_rows(folder, Box(level), Box(route), shards, kind)(iter(sorted(dealt, key=lambda r: r.column("bucket")[0].as_py()))))
    split = lambda found: (lambda rows: (sorted((r for r in rows if r.column("to")[0].is_valid), key=lambda r: (r.column("to")[0].as_py(), r.column("source")[0].as_py())), collected(rows)))(list(found))
    up, sent = split(up)
    kept, tables, rng = [], [], np.random.default_rng(seed)
    for k in range(sum(sweeps) + 1):
        if k:
            up, sent = split(py._sweep_rows(folder, Box(level), Box(route.in_order), k, seed, shards, k - 1 > sweeps[0], kind)(iter(down)))
        down, told = split(py._shard_rows(folder, Box(level), Box(route.in_order), k, seed, kind)(iter(up)))
        level = py._next_level(level, sent, told, True, rng)
        if k > sweeps[0]:
            kept.append((k, level))
            numbers = {r.column("to")[0].as_py() for r in down}
            here = [py._seated(folder, level, route.in_order, b, k, py._told([r.to_pylist()[0] for r in down if r.column("to")[0].as_py() == b])) for b in numbers]
            tables.append([level.tables0, sum(b.tables1[b.own].sum() for b in here) + level.tables1.sum(), sum(b.tables2.sum() for b in here)])
    total = np.zeros(len(texts))
    for r in py._score_rows(folder, Box(kept), Box(route.in_order), sum(sweeps), kind)(iter(down)):
        at, _, _, logs = py._unpack(r.column("block")[0].as_py())
        total[at] += logs
    return np.array(tables), total, level


def collected(rows):
    out = {}
    for r in rows:
        for s in r.column("stats")[0].as_py() or []:
            out.setdefault(s["kind"], {})
            out[s["kind"]][s["key"]] = out[s["kind"]].get(s["key"], 0) + s["n"]
    return out


@pytest.mark.parametrize("fixed", [((1.0, 1.0, 1.0), (0.5, 0.75, 0.75)), ((5.0, 2.0, 0.5), (0.2, 0.4, 0.6))])
def test_against_a_plain_sampler(tmp_path, fixed):
    texts = corpus(3)
    held = [i % 5 == 1 for i in range(len(texts))]
    toks = [[*t.split(), "</s>"] for t in texts]
    grams = lambda t: [(tuple(["<s>", "<s>", *t][i : i + 2][::-1]), w) for i, w in enumerate(t)]
    train = [g for t, h in zip(toks, held, strict=True) if not h for g in grams(t)]
    model = Plain(*fixed, 1 / (len({w for _, w in train}) + 1), random.Random(2))
    for c, w in train:
        model.add(c, w)
    sums, mean = np.zeros(3), [np.zeros(len(t)) for t in toks]
    for sweep in range(120):
        for c, w in train:
            model.remove(c, w)
            model.add(c, w)
        if sweep >= 20:
            sums += np.array(model.tables()) / 100
            for t, p in zip(toks, mean, strict=True):
                p += [model.prob(c, w) / 100 for c, w in grams(t)]
    n = sum(len(t) for t, h in zip(toks, held, strict=True) if h)
    held = np.array(held)
    plain = sum(np.log10(p).sum() for p, h in zip(mean, held, strict=True) if h) / n
    runs = []
    begin, w0, w7 = int(py.BEGIN), *(int(py.text_tokens(*_text.text_bytes(pa.array([w])))[0][0]) for w in ("w0", "w7"))
    code = lambda a, b: int(py._code(np.array([a], np.uint64), np.array([b], np.uint64))[0])
    for i, hot in enumerate((((), ()), ((begin, w0, w7), (code(begin, begin), code(w7, w0))))):
        tables, total, level = learn(texts, held.tolist(), f"file://{tmp_path}/{i}", fixed, hot)
        assert np.abs(tables.mean(axis=0) / sums - 1).max() < 0.08, (tables.mean(axis=0), sums)
        runs.append(total[held].sum() / n)
        assert (level.tables1.sum() > 0) == bool(hot[0]) and (level.tables2.sum() > 0) == bool(hot[1])
    assert abs(runs[0] - plain) < 0.006 and abs(runs[1] - plain) < 0.006, (runs, plain)


def test_strengths_and_discounts_are_found():
    """Drawn from the tables of restaurants with known ones, they come back."""
    rng, gen = random.Random(1), np.random.default_rng(1)
    for strength, discount in ((3.0, 0.6), (20.0, 0.2)):
        customers, tables, dishes = [], [], {}
        for _ in range(300):
            sizes, n = [], 60
            for k in range(n):
                at = rng.choices(range(len(sizes) + 1), [m - discount for m in sizes] + [strength + discount * len(sizes)])[0]
                if at == len(sizes):
                    sizes.append(0)
                sizes[at] += 1
            customers.append(n)
            tables.append(len(sizes))
            for m in sizes:  # each table a dish of its own
                if m > 1:
                    dishes[m << 20 | 1] = dishes.get(m << 20 | 1, 0) + 1
        s, found = strength, []
        for turn in range(60):
            stats = py._house_stats(1, np.array(customers), np.array(tables), s, gen)
            s, d = py._resample(s, {k: n for kind, k, n in stats if kind == 11}, dishes, sum(n for kind, _, n in stats if kind == 31), gen)
            found.append((s, d))
        s, d = np.mean(found[20:], axis=0)
        assert abs(d - discount) < 0.06 and abs(s - strength) < 0.25 * strength + 0.5, (s, d)


def _seated(n, strength, discount, rng):
    """Customers of each table of a restaurant of n."""
    at, size = [], []
    for i in range(n):
        k = len(size)
        if rng.random() * (strength + i) < strength + discount * k:
            size.append(0)
        else:
            k = at[int(rng.random() * i)]
            while rng.random() * size[k] >= size[k] - discount:
                k = at[int(rng.random() * i)]
        size[k] += 1
        at.append(k)
    return np.array(size)


@pytest.mark.parametrize(("discount", "n"), [(0.5, 4000), (0.5, 400_000), (0.7, 200_000)])
def test_discounts_are_found_with_dishes_of_any_size(discount, n):
    gen = np.random.default_rng(3)
    size = _seated(n, 10.0, discount, random.Random(3))
    share = 1 / np.arange(1, 20_001)
    dish = gen.choice(20_000, len(size), p=share / share.sum())
    customers, tables = np.bincount(dish, size).astype(np.int64), np.bincount(dish)
    customers, tables = customers[tables > 0], tables[tables > 0]
    assert (n < 5000) or tables[customers > py.WEIGHED].sum() > 0.2 * len(size)
    stats = py._dish_stats(1, customers, tables)
    dishes, large = ({k: v for kind, k, v in stats if kind == name} for name in (21, 41))
    strength, found = 10.0, []
    for _ in range(60):
        house = py._house_stats(1, np.array([n]), np.array([len(size)]), strength, gen)
        strength, d = py._resample(strength, {k: v for kind, k, v in house if kind == 11}, dishes, sum(v for kind, _, v in house if kind == 31), gen, large)
        found.append(d)
    assert abs(np.mean(found[20:]) - discount) < 0.03


@pytest.mark.parametrize("discount", [0.05, 0.25, 0.5, 0.55, 0.75, 0.95])
def test_logs_beyond_the_table(discount):
    """Against the recursion for 3000 customers, in units of the log."""
    many = 3000
    t, logs = np.arange(many + 2), np.full(many + 2, -np.inf)
    logs[1] = 0.0
    for c in range(1, many):
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(c - t * discount, 0)) + logs
        logs = np.logaddexp(np.where(t <= c, stay, -np.inf), np.concatenate([[-np.inf], logs[:-1]]))
    some = np.array([1, 2, 5, 20, 100, max(2, int(many**discount)), 700, 1490, 1510, 2400, 2900, many - 1, many])
    assert np.abs(py._logs(np.full(len(some), many), some, discount) - logs[some]).max() < (5 if discount > 0.9 else 1)


def test_probabilities_sum_to_one(tmp_path):
    texts = corpus(5, 20)
    word, doc = py.text_tokens(*_text.text_bytes(pa.array(texts)))
    words, at = np.unique(np.append(word, py.BEGIN), return_inverse=True)
    w = at[:-1]
    level = py.Level((1.0, 2.0, 3.0), (0.3, 0.5, 0.7))
    b, row = py.Bucket.of(words, [py._before(w, doc, 1, at[-1]), w, py._before(w, doc, 2, at[-1])], np.ones(len(w), dtype=bool), level.pairs)
    assert (words[b.dish_word[b.to1[row]]] == word).all() and (b.customers == np.bincount(row)).all()
    common = words[::3]
    again = py.Bucket.load(b.static(common), common)
    assert all((getattr(b, k) == getattr(again, k)).all() for k in ("words", "in1", "in2", "to1", "customers", "where", "hot2"))
    b.spread(level)
    b.begin()
    rng = np.random.default_rng(1)
    b.tables2 = np.where(b.customers > 1, rng.integers(1, b.customers + 1), b.customers)
    b.customers1 = np.bincount(b.to1, b.tables2).astype(np.int64)
    b.tables1 = rng.integers(1, b.customers1 + 1)
    c0 = b.sent()[0]
    t0 = np.minimum(c0, 1)
    level.customers0, level.tables0, level.types, level.tokens = int(c0.sum()), int(t0.sum()), len(b.served), len(word)
    root = level.root(c0, t0)
    unknown = (level.strength[0] + level.discount[0] * level.tables0) * level.base / (level.strength[0] + level.customers0)
    assert root.sum() + unknown == pytest.approx(1)
    got = b.probabilities(level, c0, t0)
    c1, t1, c2, t2 = b.totals(level)
    for pair in range(0, b.n_pairs, 7):
        rows = np.flatnonzero(b.in2 == pair)
        house = b.in1[b.to1[rows[0]]]
        one = py.predict(2.0, 0.5, c1[house], t1[house], np.zeros(len(root)), np.zeros(len(root)), root)
        dishes = np.flatnonzero(b.in1 == house)
        one[b.where[dishes]] = py.predict(2.0, 0.5, c1[house], t1[house], b.customers1[dishes], b.tables1[dishes], root[b.where[dishes]])
        none = (2.0 + 0.5 * t1[house]) / (2.0 + c1[house]) * unknown
        assert one.sum() + none == pytest.approx(1)
        two = py.predict(3.0, 0.7, c2[pair], t2[pair], np.zeros(len(root)), np.zeros(len(root)), one)
        two[b.where[b.to1[rows]]] = got[rows]
        assert two.sum() + (3.0 + 0.7 * t2[pair]) / (3.0 + c2[pair]) * none == pytest.approx(1)


def test_rank_of_many_columns():
    rng = np.random.default_rng(2)
    a, b, c = (rng.integers(0, 6, 500) for _ in range(3))
    for most in (6, 1 << 40):
        order, fresh = py._rank((a, b, c), most)
        rows = list(zip(a[order], b[order], c[order], strict=True))
        assert rows == sorted(rows) and fresh.sum() == len(set(rows))


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = {r[0]: r[1:] for r in brute(rows)}
    held = {}
    for options in ({"bucket_tokens": 40_000}, {"bucket_tokens": 80_000, "hot": 4_000, "unit_tokens": 60_000, "fan": 2}):
        got = {r.doc_id: r for r in py.score(df, **options).collect()}
        assert got.keys() == want.keys()
        for d, (n, known, train, base) in want.items():
            r = got[d]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train) and r.base_score == pytest.approx(base, rel=1e-9)
        some = [r for r in got.values() if r.held_out]
        assert 0 < len(some) < 400
        held[len(options)] = (sum(r.score for r in some) - sum(r.base_score for r in some)) / sum(r.n_tokens for r in some)
    assert min(held.values()) > 0.8 and abs(held[1] - held[4]) < 0.03, held  # log10 per token


def test_very_long_text(spark):
    df = spark.createDataFrame([(2, "one two three " * 200_000), (3, "one two three"), (5, "three two one")], "doc_id long, text string")
    got = {r.doc_id: r for r in py.score(df, hot=100_000).collect()}
    assert got[2].n_tokens == 600_001 and got[3].score > got[5].score


def test_large_dishes_work_out_each_discount_once():
    py._scaled.cache_clear()
    customers, tables = np.array([3000, 5000, 9]), np.array([40, 2600, 3])
    first = py._dish_stats(1, customers, tables)
    assert py._dish_stats(1, customers, tables) == first and py._scaled.cache_info().misses == len(py.GRID)
