"""Each operator against a brute-force version, on awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphweft.llm import codec, decontamination, jaccard_join, language_id, packing, pitman_yor, quotations, sharding, token_counts, token_files, topk
from graphweft.llm.codec import pack, pack_rising, unpack, unpack_rising
from graphweft.llm.queries import QUERIES, SQL
from graphweft.llm.tokenizing import tokenizer_path

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that was for with from thorreou ndernt whst ingher esthe ouen ndre sher anth atble".split()


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def awkward(seed=0):
    draw = random.Random(seed)
    base = sentence(draw, 120)
    texts = [None, "", "   \n\t", "a", "A b c", "...", base, base, base.upper(), base.replace("the", "THE", 1), base + " x", sentence(draw, 3000), "Ünïcödé ÀÉ été ² ½   x", "<|endoftext|> a <|startoftext|>", "a  b\n\n c \t d\n", "é́ 漢字 one"]
    texts += [" ".join(base.split()[:k] + [f"w{k}"] + base.split()[k:]) for k in range(0, 120, 9)]
    texts += [sentence(draw, draw.randrange(1, 60)) for _ in range(30)]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[6]]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with repeats, a clashing column, and more than one partition."""
    return spark.createDataFrame(awkward(), DOCS).withColumn("score", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 1


def test_shards(docs, none):
    rows = [r.asDict() for r in sharding.assign_shards(docs, 4).collect()]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in awkward())
    total, by = sum(r["size"] for r in rows), collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    last = -1
    for k in sorted(by):
        ids = [r["doc_id"] for r in sorted(by[k], key=lambda r: r["slot"])]
        assert [r["slot"] for r in sorted(by[k], key=lambda r: r["slot"])] == list(range(len(ids)))
        assert ids == sorted(ids) and ids[0] >= last
        last = ids[-1]
        assert abs(sum(r["size"] for r in by[k]) - total / 4) <= max(r["size"] for r in rows)
    assert sharding.assign_shards(none).count() == 0


def test_write_shards(docs, spark, tmp_path):
    clashing = docs.withColumn("size", F.length("text")).withColumn("slot", F.lit("mine")).withColumn("text_crc32", F.lit(None).cast("long"))
    sharding.write_shards(clashing, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.columns == [*clashing.columns, "shard"]
    assert sorted_rows(back.drop("shard")) == sorted_rows(clashing)
    placed = {(r.doc_id, r.shard) for r in sharding.assign_shards(docs, 3).collect()}
    assert {(r.doc_id, r.shard) for r in back.select("doc_id", "shard").collect()} == placed
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("shard", F.lit(1)), str(tmp_path / "other"), 3)
    with pytest.raises(ValueError):
        sharding.assign_shards(clashing, 3, keep=("size",))


# 2

THREAD = [
    (1, 0, "user", "Hello all.\nHow do I sort?\n\nThanks a lot"), (1, 1, "assistant", "> How do I sort?\n> Hello\nUse sort."), (1, 2, None, ">> hello all. How do I SORT?\n> Use   sort.\nThat works."),
    (1, 3, "user", "> hello all. how do i sort?\nMe too.\n> unknown words"), (1, 4, "user", None), (1, 5, "user", ""), (1, 6, "user", "> That works.\n\n> Me too.\nGood"),
    (2, 0, "user", "> How do I sort?\nno link across conversations"), (2, 1, "user", "same"), (2, 1, "user", "same"), (2, 2, "user", "> same\nyes"), (None, 1, "user", "same"), (3, None, "user", "> same"),
]


def test_quotations(spark):
    messages = spark.createDataFrame(THREAD, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(7))
    got = {(r.conv_id, r.turn, r.body): r for r in quotations.build_conversations(messages).collect()}
    by = {(c, t): r for (c, t, _), r in got.items()}
    assert by[1, 3].parent == 0 and by[1, 3].depth == 1 and by[1, 3].body == "Me too."
    assert by[1, 2].parent == 1 and by[1, 2].root == 1 and by[1, 2].n_quotes == 2 and by[1, 2].role == "user"
    assert by[1, 6].parent == 3 and by[1, 6].root == 0 and by[1, 6].depth == 2
    assert by[2, 0].parent == -1 and by[2, 2].parent == 1
    assert sorted(r.position for (c, *_), r in got.items() if c == 1) == list(range(7))
    assert by[1, 4].body == "" and by[1, 1].parent == -1


def test_quotations_match_sql(spark):
    draw, rows = random.Random(5), []
    for c in range(6):
        said = []
        for t in range(12):
            quoted = [f"{'>' * draw.choice([1, 1, 2])} {x.upper() if draw.random() < 0.3 else x}" for x in draw.sample(said, min(len(said), draw.randrange(3)))]
            own = sentence(draw, 4)
            said.append(own)
            rows.append((c, t, draw.choice(["user", "assistant"]), "\n".join([*quoted, own])))
    con = duckdb.connect()
    table = pa.table(list(map(list, zip(*rows))), names=["conv_id", "turn", "role", "text"])
    con.register("conversations", table)
    found = con.execute(SQL["op2_quotation_chat"])
    names = [c[0] for c in found.description]
    expected = [dict(zip(names, r)) for r in found.fetchall()]
    got = [r.asDict() for r in quotations.build_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    key = lambda r: (r["conv_id"], r["turn"])
    assert sorted(got, key=key) == sorted(({k: r[k] for k in got[0]} for r in expected), key=key)
    assert any(r["depth"] > 1 for r in got)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    got = QUERIES[name](spark, DATA).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))


# 3


def test_top_k(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(size=12)]) for i in range(120)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), rows[5], (300, None), (301, [None] + [1.0] * 11), (302, [float("nan")] * 12), (303, [float("inf")] + [0.0] * 11), (304, [1.0]), (305, [])]
    vectors = topk.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)))
    got = sorted_rows(topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5))
    good = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in rows if v and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for q in sorted(i for i in good if i % 50 == 0):
        best = sorted(((-int(good[q] @ good[c]), c) for c in good if c != q))[:5]
        expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == expected
    assert topk.top_k(vectors.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    test_top_k(spark)


# 4


def brute_base(rows, held):
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", fold(t)) + [None]) for i, t, *_ in rows]
    c = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens)


def test_small_numbers_round_trip():
    for values in ([], [0], [254, 255, 256], [0, 255, 1 << 32, (1 << 64) - 1, 7], list(range(0, 3000, 7))):
        assert codec.unpack_small(codec.pack_small(np.array(values, np.uint64))).tolist() == values


def test_language_model(docs, none, monkeypatch):
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    rows = pitman_yor.score_documents(docs, held).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == brute_base(awkward(), lambda i: zlib.crc32(str(i).encode()) % 10 == 0)
    assert all(r.score < 0 for r in rows)
    assert pitman_yor.score_documents(none, held).count() == 0
    all_held = pitman_yor.score_documents(docs, F.lit(True)).collect()
    assert {r.train_tokens for r in all_held} == {0} and all(abs(r.score) < 1e-9 for r in all_held)


def corpus(seed=2, n=300):
    draw = random.Random(seed)
    follow = {w: draw.sample(WORDS, 3) for w in WORDS}
    rows = []
    for i in range(n):
        text = [draw.choice(WORDS)]
        for _ in range(30):
            text.append(draw.choice(follow[text[-1]]))
        rows.append((i, " ".join(text), "en", "s", 0))
    return rows


class Plain:
    """The same model on dictionaries, one process, from one list of training texts; words are their hashes."""

    def __init__(self, texts, sweeps, discounts=(0.6, 0.75, 0.85), strengths=(10.0, 2.0, 1.0)):
        self.discounts, self.strengths, self.states = discounts, strengths, []
        self.count = collections.Counter(x for t in texts for x in self.triples(t))
        self.vocabulary = {x[2] for x in self.count}
        for sweep in range(sweeps + 1):
            self.states.append(self.swept(sweep))

    @staticmethod
    def words(text):
        return [int(x) for x in pitman_yor.word_hashes([text.encode()])[0]] + [int(pitman_yor._END[0])]

    def triples(self, text):
        w = [int(pitman_yor._BEGIN[0])] * 2 + self.words(text)
        return list(zip(w, w[1:], w[2:]))

    @staticmethod
    def key(*words):
        step, h = pitman_yor._STEP, lambda x: np.array([x], np.uint64)
        first = pitman_yor.mix(h(words[0]) * step + h(words[1]))
        return (first if len(words) == 2 else pitman_yor.mix(first + h(words[2]) * step)) >> np.uint64(64 - pitman_yor.HASH_BITS)

    def seated(self, customers, level, key, parent, own_tables, sweep):
        if not sweep:
            return int(customers > 0)
        pull = (self.strengths[level] + self.discounts[level] * own_tables) * parent
        return int(pitman_yor.seat(np.array([customers]), np.array([pull]), self.discounts[level], key, sweep)[0])

    def swept(self, sweep):
        old = self.states[-1] if sweep else None
        s = {"c3": self.count, "t3": {}, "c2": collections.Counter(), "t2": {}, "c1": collections.Counter(), "t1": {}, "T3": collections.Counter(), "C3": collections.Counter(), "T2": collections.Counter(), "C2": collections.Counter()}
        for (x, v, w), c in self.count.items():
            t = s["t3"][x, v, w] = self.seated(c, 2, self.key(x, v, w), old and self.lower(old, v, w), old and old["T3"][x, v], sweep)
            s["c2"][v, w] += t
            s["T3"][x, v] += t
            s["C3"][x, v] += c
        for (v, w), c in s["c2"].items():
            t = s["t2"][v, w] = self.seated(c, 1, self.key(v, w), old and self.root(old, w), old and old["T2"][v], sweep)
            s["c1"][w] += t
            s["T2"][v] += t
            s["C2"][v] += c
        for w, c in s["c1"].items():
            # the root's tables are sampled in the first seating too, from no tables before
            pull = (self.strengths[0] + self.discounts[0] * (sum(old["t1"].values()) if old else 0.0)) / (len(self.vocabulary) + 1)
            s["t1"][w] = int(pitman_yor.seat(np.array([c]), np.array([pull]), self.discounts[0], np.array([w], np.uint64), sweep)[0])
        return s

    def root(self, s, w):
        d, th, n = self.discounts[0], self.strengths[0], sum(s["c1"].values())
        return (max(0, s["c1"][w] - d * s["t1"].get(w, 0)) + (th + d * sum(s["t1"].values())) / (len(self.vocabulary) + 1)) / (th + n)

    def lower(self, s, v, w):
        d, th = self.discounts[1], self.strengths[1]
        if not s["C2"][v]:
            return self.root(s, w)
        return (max(0, s["c2"][v, w] - d * s["t2"].get((v, w), 0)) + (th + d * s["T2"][v]) * self.root(s, w)) / (th + s["C2"][v])

    def chance(self, s, x, v, w):
        d, th = self.discounts[2], self.strengths[2]
        if not s["C3"][x, v]:
            return self.lower(s, v, w)
        return (max(0, s["c3"][x, v, w] - d * s["t3"].get((x, v, w), 0)) + (th + d * s["T3"][x, v]) * self.lower(s, v, w)) / (th + s["C3"][x, v])

    def mean(self, first, x, v, w):
        return sum(self.chance(s, x, v, w) for s in self.states[first:]) / len(self.states[first:])


def test_language_model_equals_the_plain_one(spark, monkeypatch):
    """Scores over many lots and ranges, documents cut to parts among them, are those of one process, whose probabilities sum to one."""
    rows = corpus(n=60) + [(100, " ".join(WORDS * 9), "en", "s", 0), (101, "the unseen of", "en", "s", 0), (102, "", "en", "s", 0), (103, None, "en", "s", 0)]
    learned = [t or "" for i, t, *_ in rows if i < 50 or i == 100]
    plain = Plain(learned, 2)
    for context in [(int(pitman_yor._BEGIN[0]),) * 2, *list(plain.count)[:5], (1, plain.words("of")[0]), (1, 2)]:
        assert abs(sum(plain.mean(1, *context[:2], w) for w in [*plain.vocabulary, 5]) - 1) < 1e-9
    monkeypatch.setattr(pitman_yor, "LOT_TOKENS", 120)
    monkeypatch.setattr(pitman_yor, "RANGE_TASKS", 3)
    held = (F.col("doc_id") >= 50) & (F.col("doc_id") != 100)
    found = {r.doc_id: r for r in pitman_yor.score_documents(spark.createDataFrame(rows, DOCS).repartition(3), held, sweeps=2, burn_in=1).collect()}
    assert len(found) == len(rows)
    for i, t, *_ in rows:
        expected = sum(math.log10(plain.mean(1, *x)) for x in plain.triples(t or ""))
        assert abs(found[i].score - expected) < 1e-6 * max(1, -expected), i
        assert found[i].n_tokens == len((t or "").split()) + 1


@pytest.mark.parametrize("bits", [pitman_yor.HASH_BITS, 12])
def test_sweeps_need_no_grouping_and_send_the_sums_of_the_whole_lot(bits, tmp_path, monkeypatch):
    """Once a lot's seats are written, its pairs are not grouped again; with 12 bits many hashes are shared."""
    py = pitman_yor
    monkeypatch.setattr(py, "HASH_BITS", bits)
    monkeypatch.setattr(py, "_cuts", lambda hashes, bits, ranges: [(0, slice(0, len(hashes)))])
    groups, plainly = [], py.Lot.group_pairs
    monkeypatch.setattr(py.Lot, "group_pairs", lambda lot: (groups.append(lot), plainly(lot))[1])
    model = py.Model(f"file://{tmp_path}", 1, (0.6, 0.75, 0.85), (10.0, 2.0, 1.0))
    texts = [t.encode() for _, t, *_ in corpus(n=60)] + [b"alone", b"", *(" ".join(f"w{i + k}" for k in range(100)).encode() for i in range(0, 600, 100))]
    kept, sums = [{}], []
    for lot in range(3):
        parts = [(i, i, i % 10 == 0, np.concatenate((py._BEGIN, py._BEGIN, py.word_hashes([t])[0], py._END))) for i, t in enumerate(texts) if i % 3 == lot]
        (tmp_path / f"lot-{lot}").write_bytes(py.Lot.write(parts))
        kept[0][lot] = str(tmp_path / f"lot-{lot}")

    def of(lot, *steps):
        return [kept[s][lot] for s in (0, *steps)]

    def ask(run, reduce, *steps):
        """The number of the step and the sums over all ranges."""
        sent = [b for lot in range(3) for b in run(lot, of(lot, *steps))]
        answers = pa.Table.from_batches(list(reduce(iter(sent))))
        rows = [r for lot in pc.unique(answers["lot"]) for r in model.keep(len(kept))((lot,), answers.filter(pc.equal(answers["lot"], lot))).to_pylist()]
        kept.append({r["lot"]: r["path"] for r in rows if r["lot"] >= 0})
        return len(kept) - 1, [py.unpack(r["sums"]).astype(np.int64).tolist() for r in rows if r["lot"] < 0]

    def values(batches, n):
        ((blob,),) = [b["blob"].to_pylist() for b in batches]
        return [py.unpack_small(x).tolist() for x in py.unpack_many(blob, n + 1)[1:]]

    counts, [[tokens, vocabulary, once]] = ask(model.send_counts, model.total_ranges)
    triples, _ = ask(model.send_triples, model.total_ranges, counts)
    seats = len(kept)
    kept.append({r["lot"]: r["path"] for lot in range(3) for b in model.write_seats(seats)(lot, of(lot, counts, triples)) for r in b.to_pylist()})
    written = [model._seats(of(lot, seats))[0] for lot in range(3)]
    assert any(len(x.other_words[0]) for x in written) == any(len(x.other_pairs[0]) for x in written) == (bits == 12)
    steps = []
    for sweep in range(3):
        # what the whole lot gives
        expected = []
        for lot in range(3):
            whole, shares, replies = model._opened(of(lot, counts, triples, *steps))
            total, owned = model._triple_totals(whole, shares, replies)
            state, before = (model._state(shares, replies, k, sums) if k >= 0 else None for k in (sweep - 1, sweep - 2))
            tables = model._triple_tables(whole, total * owned, state, before, sweep)
            expected.append([np.bincount(x, weights=tables, minlength=len(whole.pair_hashes))[shares.spoken].tolist() for x in (whole.parent, whole.context)])
        groups.clear()
        run, needed = model.send_pair_sums(sweep, sums), (seats, *steps)
        assert [values(run(lot, of(lot, *needed)), 2) for lot in range(3)] == expected
        steps.append(ask(run, model.add_pairs(sweep), *needed)[0])
        assert not groups
        expected = []
        for lot in range(3):
            whole, shares, replies = model._opened(of(lot, counts, triples, *steps))
            customers = shares.sums(replies[py.BY_PAIR + sweep])[0] * shares.owned
            tables = model._pair_tables(whole, customers, model._state(shares, replies, sweep - 1, sums) if sweep else None, sweep)
            add = lambda codes, x: np.bincount(codes, weights=x, minlength=len(whole.words))[shares.words].tolist()  # noqa: B023, E731
            expected.append([add(whole.pair_second, tables), add(whole.pair_first, tables), add(whole.pair_first, customers)])
        groups.clear()
        run, needed = model.send_word_sums(sweep, sums), (seats, *steps)
        assert [values(run(lot, of(lot, *needed)), 3) for lot in range(3)] == expected
        step, [[customers, root]] = ask(run, model.seat_root(sweep, vocabulary, sums[-1]["tables"] if sums else 0.0), *needed)
        assert not groups
        steps.append(step)
        sums.append({"tokens": tokens, "vocabulary": vocabulary, "customers": customers + once, "tables": root + once})


def test_grouping_equals_unique():
    draw = np.random.default_rng(3)
    alike = (np.uint64(5) << np.uint64(40)) + draw.integers(0, 9, 500, dtype=np.uint64)
    for hashes, bits in ((draw.integers(0, 900, 2000, dtype=np.uint64), 42), (draw.choice(draw.integers(0, 1 << 63, 300, dtype=np.uint64), 2000), 64), (alike, 64), (alike[:1], 64), (alike[:0], 64), (alike[:0], 42)):
        keys, some, place = pitman_yor._group(hashes, bits)
        expected, back = np.unique(hashes, return_inverse=True)
        assert keys.tolist() == expected.tolist() == hashes[some].tolist() and place.tolist() == back.tolist()


def test_language_model_agrees_with_one_customer_at_a_time(spark):
    """Held-out scores against plain Gibbs sampling that moves a single customer at a time and keeps every table's size."""
    rows, draw = corpus(n=80), random.Random(9)
    discounts, strengths = (0.6, 0.75, 0.85), (10.0, 2.0, 1.0)
    plain = Plain([], 0)
    rooms: list[dict] = [collections.defaultdict(lambda: collections.defaultdict(list)) for _ in range(3)]
    vocabulary = {w for _, t, *_ in rows[:60] for w in plain.words(t)}

    def context(level, x):
        return x[2 - level : 2]

    def chance(level, x):
        if level < 0:
            return 1 / (len(vocabulary) + 1)
        room, d, th = rooms[level][context(level, x)], discounts[level], strengths[level]
        n, t, own = sum(map(sum, room.values())), sum(map(len, room.values())), room.get(x[2], [])
        return (sum(own) - d * len(own) + (th + d * t) * chance(level - 1, x)) / (th + n) if n else chance(level - 1, x)

    def add(level, x):
        if level < 0:
            return
        room, d, th = rooms[level][context(level, x)], discounts[level], strengths[level]
        own = room[x[2]]
        weights = [n - d for n in own] + [(th + d * sum(map(len, room.values()))) * chance(level - 1, x)]
        at = draw.choices(range(len(weights)), weights)[0]
        if at == len(own):
            own.append(1)
            add(level - 1, x)
        else:
            own[at] += 1

    def remove(level, x):
        if level < 0:
            return
        room = rooms[level][context(level, x)]
        own = room[x[2]]
        at = draw.choices(range(len(own)), own)[0]
        own[at] -= 1
        if not own[at]:
            own.pop(at)
            remove(level - 1, x)
            if not own:
                del room[x[2]]

    customers = [x for _, t, *_ in rows[:60] for x in plain.triples(t)]
    for x in customers:
        add(2, x)
    total, states = collections.Counter(), 0
    for sweep in range(6):
        for x in customers:
            remove(2, x)
            add(2, x)
        if sweep >= 3:
            states += 1
            for x in {x for _, t, *_ in rows[60:] for x in plain.triples(t)}:
                total[x] += chance(2, x)
    expected = sum(math.log10(total[x] / states) for _, t, *_ in rows[60:] for x in plain.triples(t))
    found = pitman_yor.score_documents(spark.createDataFrame(rows, DOCS), F.col("doc_id") >= 60, sweeps=4, burn_in=2).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert abs(found[0] / expected - 1) < 0.02
    assert found[0] > 0.8 * found[1]


def test_seating_has_the_right_mean():
    for n, pull, discount in ((400, 0.7, 0.5), (400, 0.02, 0.8), (3000, 5.0, 0.85)):
        probabilities = np.zeros(n + 1)
        probabilities[1] = 1.0
        for i in range(1, n):
            k = np.arange(n + 1)
            new = pull / np.maximum(i - discount * k + pull, pull)
            probabilities = probabilities * (1 - new) + np.concatenate(([0], (probabilities * new)[:-1]))
        mean = (probabilities * np.arange(n + 1)).sum()
        spread = math.sqrt((probabilities * (np.arange(n + 1) - mean) ** 2).sum())
        drawn = pitman_yor.seat(np.full(20000, n), np.full(20000, pull), discount, np.arange(20000, dtype=np.uint64), 3)
        assert abs(drawn.mean() / mean - 1) < 0.03 and abs(drawn.std() / spread - 1) < 0.12


# 5, 6, 7


@pytest.fixture(scope="module")
def ids():
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t, *_ in awkward()]


def test_token_files(docs, none, ids):
    got = sorted_rows(token_files.token_digests(docs, tokenizer_path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_crc32"))
    assert got == sorted((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in token_files.token_digests(docs, tokenizer_path("word_bpe_49k.json")).collect())
    at = 0
    for start, n, _ in starts:
        assert start == at
        at += n
    assert [d for *_, d in starts] == sorted(i for i, _ in ids)
    assert token_files.token_digests(none, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_value_coding_round_trip():
    draw = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (draw.integers(0, 1 << 32, n, dtype=np.uint64) >> draw.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
        assert (token_files.decode_values(*token_files.encode_values(values), n) == values).all()
        wide = np.sort(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (unpack(pack(wide)) == wide).all() and (unpack_rising(pack_rising(wide)) == wide).all()


def test_packing(docs, none, ids):
    capacity = 256
    rows = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 1, capacity).collect()
    pieces = sorted((i, k, k * capacity, len(p), zlib.crc32(p.tobytes())) for i, x in ids for k, p in enumerate(np.split(x, range(capacity, len(x), capacity))))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for lot in bins.values():
        at = 0
        for offset, length in sorted(lot):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == len(one_by_one([r.length for r in rows], capacity))
    assert packing.pack_documents(none, tokenizer_path("word_bpe_49k.json")).count() == 0


def one_by_one(lengths, capacity):
    """The same rule, a bin at a time, on a plain list."""
    left, bins = sorted(lengths), []
    while left:
        lot = [left.pop()]
        while fit := [x for x in left if x <= capacity - sum(lot)]:
            lot.append(fit[-1])
            left.remove(fit[-1])
        gap = capacity - sum(lot)
        if gap and len(lot) > 1:
            small = min(lot)
            best = max(((a + b, max(a, b)) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= gap + small), default=(0, 0))
            if best[0] > small:
                lot.remove(small)
                left.append(small)
                for x in (best[1], best[0] - best[1]):
                    left.remove(x)
                    lot.append(x)
                left.sort()
        bins.append(sum(lot))
    return bins


def test_plans_equal_the_plain_rule():
    for seed in range(40):
        draw = random.Random(seed)
        lengths = [draw.randrange(1, 60) for _ in range(draw.randrange(1, 80))]
        plans = packing.plan_bins(collections.Counter(lengths), 60)
        used = collections.Counter()
        for lot, times in plans:
            assert sum(lot) <= 60
            used.update({n: k * times for n, k in collections.Counter(lot).items()})
        assert used == collections.Counter(lengths)
        assert sum(t for _, t in plans) == len(one_by_one(lengths, 60))


def test_token_counts(docs):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = sorted_rows(token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), 100))
    sizes = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in awkward()]
    assert got == sorted((i, b, n, n > 100) for i, b, n in sizes)


def test_token_counts_of_white_space_and_scripts(monkeypatch):
    """Blank lines, tabs, runs of spaces, endings, special strings and other scripts, cut anywhere by small windows."""
    from graphweft.llm import tokenizing

    draw = random.Random(3)
    alphabet = "ab AB'srtl 12 \n\t.,!?\u00e9\u6f22\u00bd\u00a0\u3000\u0301\u0663<|>"
    texts = [None, "", " ", "\n\n  a", "don't  you'll 's ''s 'S a's's x'tis\n's", "one\n\n\ntwo \t three  ", "<|endoftext|> x<|endoftext|>y", "a\x00b \x1c c", "x " * 50, "\U0001f642\U0001f642 ok"]
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 30))) for _ in range(800)]
    byte, word = tokenizing.ByteCounter(tokenizer_path("byte_bpe_50k.json")), tokenizing.WordCoder(tokenizer_path("word_bpe_49k.json"))
    sizes = [len(byte.model.library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    ids = [[*word.model.library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    for window in (1 << 20, 40, 5):
        monkeypatch.setattr(tokenizing, "WINDOW", window)
        assert byte.count(pa.array(texts)).tolist() == sizes
        flat, bounds = word.encode(pa.array(texts), 1)
        assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == ids
    assert byte.count(pa.array([], pa.string())).tolist() == [] and word.encode(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0, 0]


# 8


def test_language_mixture(spark, none):
    draw = random.Random(4)
    speak = {"aa": "kala mano turi sepo lina".split(), "bb": "grunz schlecht wurst knopf zweig".split(), "cc": "wy qxu vyj zuwq yxiv".split()}
    say = lambda l, n: " ".join(draw.choice(speak[l]) + draw.choice(["", "s", "x"]) for _ in range(n))
    rows = [(i, say("abc"[i % 3] * 2, 40), "abc"[i % 3] * 2, "s", 0) for i in range(240)]
    rows += [(500, None, "aa", "s", 0), (501, "123 ... !", "aa", "s", 0), (502, say("aa", 120) + " " + say("bb", 60), None, "s", 0), (503, say("cc", 9), None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in language_id.predict_languages(docs).collect()}
    assert all(got[i].lang_pred == "abc"[i % 3] * 2 for i in range(240))
    assert [got[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "aa", "cc"] and got[500].score == 0
    assert abs(got[502].score - 2 / 3) < 0.12 and got[503].score > 0.9
    assert {got[i].held_out for i in range(240)} == {True, False} and got[0].held_out == (zlib.crc32(b"0") % 5 == 0)
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 242
    assert language_id.predict_languages(none).count() == 0
    unlabelled = language_id.predict_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


# 9


def brute_hits(rows, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = find(t)
        for k in range(len(w) - min(window, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + window])].add(i)
    out = []
    for i, t, *_ in rows:
        w, hit, found = find(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        named = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out)


ITEMS = [(1, "the of and to in that was for with from the of"), (2, "thorreou whst"), (10, "Sher, anth; atble the OF and to in that was for"), (3, None), (4, "..."), (5, "unheard"), (5, "unheard"), (None, "ouen ndre sher"), (7, "a")]


@pytest.mark.parametrize(("limit", "automata"), [(200_000, 4), (12, 40), (12, 2)])
def test_decontamination(spark, docs, monkeypatch, limit, automata):
    monkeypatch.setattr(decontamination, "AUTOMATON_WORDS", limit)
    monkeypatch.setattr(decontamination, "SCAN_AUTOMATA", automata)
    extra = [(900, "x " + ITEMS[0][1] + " y " + ITEMS[2][1], "en", "s", 0), (901, ITEMS[0][1].upper().replace(" ", "--"), "en", "s", 0)]
    rows = awkward() + extra
    table = docs.select(*DOCS.replace(" long", "").replace(" string", "").split(", ")).union(spark.createDataFrame(extra, DOCS))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("row", F.lit(1))
    got = decontamination.contamination_digest(decontamination.find_contamination(table.withColumn("row", F.lit(0)), bench, 10))
    assert sorted(tuple(r) for r in got.collect()) == brute_hits(rows, ITEMS)


def test_cutting(spark, none):
    passage = ITEMS[0][1]
    rows = [(0, f"Start here, {passage.upper()}! And on.", "en", "s", 1), (1, passage, "en", "s", 1), (2, "clean words", "en", "s", 11), (3, None, None, None, None)]
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    kept = {r.doc_id: r for r in decontamination.remove_contamination(spark.createDataFrame(rows, DOCS), bench, max_coverage=0.9).collect()}
    assert sorted(kept) == [0, 2, 3] and kept[0].text == "Start here, ! And on." and kept[0].n_chars == len(kept[0].text)
    assert kept[2].text == "clean words" and kept[2].n_chars == 11
    assert decontamination.remove_contamination(none, bench).count() == 0
    assert decontamination.remove_contamination(spark.createDataFrame(rows, DOCS), bench.where("false")).count() == 4


def test_cutting_short_items(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "what is the answer"), (2, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    long = " ".join(f"w{i}" for i in range(12))
    rows = [
        (0, "What is the answer?"), (1, "He asked: what is the ANSWER, and then he left the room."), (2, "what is the question"),
        (3, f"one two three {long} four five six seven what is the answer eight nine ten eleven twelve"), (4, f"one what is the answer two three {long}"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)

    def check():
        # one item alone goes; 16 of 19 words of two items go though neither makes up 80 % alone
        kept = {r.doc_id: r for r in decontamination.remove_contamination(docs, bench).collect()}
        assert {i: r.text for i, r in kept.items()} == {
            1: "He asked: , and then he left the room.", 2: "what is the question", 3: "one two three  four five six seven  eight nine ten eleven twelve",
        }
        assert all(r.n_chars == len(r.text) for r in kept.values())
        # a stretch within max_span stays, but counts
        kept = {r.doc_id: r.text for r in decontamination.remove_contamination(docs, bench, max_span=12).collect()}
        assert sorted(kept) == [1, 2, 3] and kept[3] == f"one two three {long} four five six seven  eight nine ten eleven twelve"

    check()
    monkeypatch.setattr(decontamination, "AUTOMATON_WORDS", 5)
    check()
    monkeypatch.setattr(decontamination, "SCAN_AUTOMATA", 1)
    check()


def test_long_items_are_cut_to_overlapping_parts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "AUTOMATON_WORDS", 20)
    draw = random.Random(8)
    item = sentence(draw, 90)
    words = item.split()
    rows = [(i, " ".join(["x"] * 3 + words[i : i + 14] + ["y"]), "en", "s", 0) for i in range(70)]
    found = decontamination.find_contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(4, item)], "item_id long, text string"))
    assert sorted(tuple(r) for r in decontamination.contamination_digest(found).collect()) == brute_hits(rows, [(4, item)])


# 10


def brute_components(rows, words, percent):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[j]:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i, *_ in rows)


@pytest.mark.parametrize(("words", "percent", "rare", "block", "homes", "tasks"), [(4, 85, 32, 2048, 8, 20_000), (5, 80, 2, 5, 1, 20_000), (2, 60, 3, 3, 8, 3)])
def test_jaccard(docs, monkeypatch, words, percent, rare, block, homes, tasks):
    monkeypatch.setattr(jaccard_join, "RARE", rare)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard_join, "HOMES", homes)
    monkeypatch.setattr(jaccard_join, "RANGE_TASKS", tasks)
    got = jaccard_join.jaccard_components(docs, words, percent)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(awkward(), words, percent)


def test_jaccard_signatures_never_miss():
    """Random pairs at and above the bound share a signature, for rare and frequent shingles."""
    draw = np.random.default_rng(7)
    for trial in range(300):
        size, percent = int(draw.integers(1, 400)), int(draw.choice([60, 80, 85, 95]))
        base = draw.choice(1 << 40, size + 60, replace=False).astype(np.uint64)
        weight = dict(zip(base.tolist(), draw.choice([2, 3, 40, 500], len(base)).tolist()))
        a, b = base[:size], np.concatenate((base[: size - int(draw.integers(0, max(1, size // 6)))], base[size : size + int(draw.integers(0, 30))]))
        common = len(np.intersect1d(a, b))
        if 100 * common < percent * (len(a) + len(b) - common):
            continue
        found = [jaccard_join.signatures(len(x), np.sort(x), np.array([weight[t] for t in np.sort(x).tolist()]), percent) for x in (a, b)]
        assert len(np.intersect1d(*found)), (size, percent)


def test_repeated_ids(spark):
    """An id with several texts is one document; no text is lost without a copy that stays."""
    draw = random.Random(11)
    x, y, z = (sentence(draw, 60) for _ in range(3))
    rows = [(3, y, "en", "s", 0), (5, x, "en", "s", 0), (5, y, "en", "s", 0), (7, x, "en", "s", 0), (9, z, "en", "s", 0), (9, None, "en", "s", 0), (7, "", "en", "s", 0), (None, x, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    n = len({tuple(x.split()[k : k + 4]) for k in range(57)})
    got = sorted_rows(jaccard_join.jaccard_components(docs, 4, 85).select("doc_id", "component_id", (F.col("n_shingles") == n).alias("is_x")))
    assert [r[:2] for r in got] == [(None, None), (3, 3), (5, 3), (5, 3), (7, 3), (7, 3), (9, 9), (9, 9)]
    kept = sorted_rows(jaccard_join.keep_one_of_each(docs, 5, 80).select("doc_id", "text"))
    assert kept == sorted([(None, x), (3, y), (5, x), (7, ""), (9, None), (9, z)], key=lambda r: tuple((v is not None, v) for v in r))


def test_random_families(spark, monkeypatch):
    """Families of near copies that overlap by shared passages, with lists wider than the homes allowed."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard_join, "HOMES", 2)
    monkeypatch.setattr(jaccard_join, "RARE", 4)
    draw = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    passages = [[draw.choice(words) for _ in range(40)] for _ in range(6)]
    rows = []
    for i in range(160):
        text = [w for p in draw.sample(passages, 2) for w in p] + [draw.choice(words) for _ in range(draw.choice([0, 4, 12, 30]))]
        for _ in range(draw.choice([0, 1, 2, 6])):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((i, " ".join(text), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for size, percent in ((3, 70), (4, 85)):
        assert sorted(tuple(r) for r in jaccard_join.jaccard_components(docs, size, percent).collect()) == brute_components(rows, size, percent)


def test_keep_one(docs, none):
    kept = jaccard_join.keep_one_of_each(docs, 5, 80)
    expected = {c for _, _, c in brute_components(awkward(), 5, 80)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected) and kept.columns == docs.columns
    assert jaccard_join.keep_one_of_each(none).count() == 0


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
