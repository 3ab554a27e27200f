"""Operators for training data: brute force, exact round trips, and defined results for odd input."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brineflow.llm import backward_index, containers, format_duplicates, personal_data, queries, reagent_mapping, related_splits, split_overlap, term_counts, tokenizer_automaton
from brineflow.operators import packed
from tests.compare import assert_same, database

ACCEPTED = frozenset(packed.CANDIDATES) - {"colon", "word_at", "word_in", "stop"}


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def recipes(spark):
    """Records with repeats, other looks, small changes, nulls, blanks and a very long text; columns that clash with the results."""
    rng = random.Random(2)
    names = ["sodium chloride", "mops buffer", "lithium sulfate", "polyethylene glycol", "glycerol", "potassium nitrate"]
    out = []
    for i in range(160):
        values = [f"{n} {rng.randrange(1, 9)}.{rng.randrange(9)} mM" for n in rng.sample(names, 4)] + [f"tray {rng.randrange(10**6):06d} drop x{i}y"]
        out.append(values)
        if i % 4 == 0:
            out.append([v.upper() for v in rng.sample(values, len(values))])
        if i % 5 == 0:
            out.append([*values[:-1], f"tray {rng.randrange(10**6):06d} drop x{i}y"])
    texts = [rng.choice(["; ", " | ", "\n", ", "]).join(v) for v in out] + [None, "", "  ", "--", "; ".join(f"long{i} value {i} mM" for i in range(4000))] + [out and "; ".join(out[0])] * 12
    data = [(i, t, "train" if i % 3 else rng.choice(["val", "test", None]), f"E{i // 2} " if i % 7 else None if i % 2 else "", rng.choice(["c1", "c1", "c2", f"k{i}", None, " "]), "s", "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "record_id bigint, raw_details string, split string, pdb_id string, cluster_30 string, source string, content string, n_copies int, label string")


def test_format_duplicates(recipes):
    groups = defaultdict(list)
    for r in recipes.collect():
        if c := packed.canonical_content(r["raw_details"], ACCEPTED):
            groups[c].append(r["record_id"])
    want = sorted((min(g), len(g)) for g in groups.values() if len(g) > 1)
    assert rows(format_duplicates.duplicate_sets(recipes, "record_id", "raw_details", "source"), "record_id", "n_copies") == want
    assert format_duplicates.duplicate_sets(recipes.limit(0), "record_id", "raw_details", "source").count() == 0


def test_backward_index_finds_every_maximal_match():
    rng = np.random.default_rng(4)
    sequences = [rng.integers(1, 6, size=rng.integers(1, 7)) for _ in range(40)] + [np.array([2, 3, 1])] * 5
    index = backward_index.BackwardIndex(np.concatenate(sequences), np.array([len(s) for s in sequences]))
    patterns = [rng.integers(1, 6, size=4) for _ in range(20)]
    which, owner, span = index.maximal_matches(np.array(patterns), np.full(20, 4))
    got = Counter(zip(which.tolist(), owner.tolist(), span.tolist()))
    want = Counter()
    for p, pattern in enumerate(patterns):
        for s, seq in enumerate(sequences):
            for end in np.flatnonzero(seq == pattern[0]):
                n = 0
                while n < 4 and n <= end and seq[end - n] == pattern[n]:
                    n += 1
                want[p, s, n] += 1
    assert got == want


def test_cross_split_pairs(recipes, monkeypatch):
    word = re.compile(r"(?:[^\W_]|(?<=\d)[.,](?=\d))+")
    data = [(r["record_id"], r["split"], frozenset(word.findall((r["raw_details"] or "").lower())), packed.canonical_content(r["raw_details"], ACCEPTED), (r["pdb_id"] or "").strip().upper()) for r in recipes.collect()]
    train, evaluation = [d for d in data if d[1] == "train"], [d for d in data if d[1] in ("val", "test")]
    want = {
        (e[0], t[0]) for e in evaluation for t in train
        if (e[2] and t[2] and 5 * len(e[2] & t[2]) >= 4 * len(e[2] | t[2])) or (e[3] and e[3] == t[3]) or (e[4] and e[4] == t[4])
    }
    run = lambda df: set(rows(split_overlap.cross_split_pairs(df, "record_id", "raw_details", "pdb_id", "split", "source"), "eval_id", "train_id"))
    assert run(recipes) == want
    monkeypatch.setattr(split_overlap, "CELL", 2)  # every shared symbol is cut into cells
    assert run(recipes) == want
    assert run(recipes.limit(0)) == set()


def _shard(n_train: int, n_eval: int, shared: list[int], rng: random.Random) -> pa.Table:
    """One cell whose sequences share symbols of `shared`, after a rare one of their own and the symbol they met by."""
    side = [True] * n_train + [False] * n_eval
    tails = [[1, *sorted(rng.sample(shared, len(shared) * 9 // 10)), 10_000 + i] for i in range(len(side))]
    columns = [pa.array([b"%d" % i for i in range(len(side))], pa.binary()), pa.array(side), pa.array([7] * len(side), pa.int64()), pa.array(list(map(len, tails)), pa.int32()), pa.array(tails, pa.list_(pa.int64()))]
    return pa.table(columns, names=["class_id", "train", "cell", "n", "tail"])


def test_search_of_a_dense_shard_holds_a_bounded_part_of_its_pairs():
    import tracemalloc

    table = _shard(500, 500, list(range(2, 42)), random.Random(3))
    tracemalloc.start()
    found = split_overlap._search(table, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sets = [set(t) for t in table.column("tail").to_pylist()]
    want = sum(len(sets[t] & sets[e]) >= 0.8 * len(sets[t] | sets[e]) - 1e-9 for t in range(500) for e in range(500, 1000))
    assert found.num_rows == want > 0
    assert peak < 60e6


@pytest.mark.parametrize("hits", [1, 90, 1_000_000])
def test_search_in_parts_finds_the_same_pairs(monkeypatch, hits):
    monkeypatch.setattr(split_overlap, "HITS", hits, raising=False)
    table = _shard(30, 20, list(range(2, 22)), random.Random(4))
    sets = [set(t) for t in table.column("tail").to_pylist()]
    want = {(b"%d" % e, b"%d" % t, len(sets[t] & sets[e])) for t in range(30) for e in range(30, 50) if len(sets[t] & sets[e]) >= 0.8 * len(sets[t] | sets[e]) - 1e-9}
    found = split_overlap._search(table, 0.8)
    assert {(r["eval_class"], r["train_class"], r["common"]) for r in found.to_pylist()} == want and found.num_rows == len(want) > 0


def test_shards_are_as_many_as_the_cells_need(spark, monkeypatch):
    """A class of a symbol with many classes is in many cells; those rows count, not the classes."""
    monkeypatch.setattr(split_overlap, "CELL", 2)
    assert split_overlap._placed_rows(spark.createDataFrame([(10, 5), (1, 1)], "n_train bigint, n_eval bigint")) == 10 * 3 + 5 * 5 + 2
    assert split_overlap._placed_rows(spark.createDataFrame([], "n_train bigint, n_eval bigint")) == 0


def test_term_counts(spark, monkeypatch):
    rng = random.Random(8)
    terms = [("Hot  term" if rng.random() < 0.4 else f" t{rng.randrange(300)} ", rng.choice([None, "", " ", "B"]), rng.randrange(-50, 70_000), "clash") for _ in range(3000)]
    df = spark.createDataFrame(terms, "a string, b string, record_id bigint, term string").repartition(5)
    want = Counter(), defaultdict(set)
    for a, b, r, _ in terms:
        for f, v in (("a", a), ("b", b)):
            if v and (t := " ".join(v.lower().split())):
                want[0][f, t] += 1
                want[1][f, t].add(r)
    got = {(r["field"], r["term"]): (r["n_rows"], r["n_records"]) for r in term_counts.count_terms(df, ["a", "b"], "record_id").collect()}
    assert got == {k: (n, len(want[1][k])) for k, n in want[0].items()}
    monkeypatch.setattr(term_counts, "FAN_IN", 2)  # chunks of five tasks are united in three steps
    assert {(r["field"], r["term"]): (r["n_rows"], r["n_records"]) for r in term_counts.count_terms(df, ["a", "b"], "record_id").collect()} == got
    assert term_counts.heavy_terms(df.select(F.lit("a").alias("field"), term_counts.normal_term(F.col("a")).alias("term"))).keys() >= {("a", "hot term")}
    assert term_counts.marked_terms(df.limit(0), ["a"], "record_id").count() == 0
    nulls = spark.createDataFrame([("x", None), ("x", 1)], "a string, record_id bigint")
    assert rows(term_counts.marked_terms(nulls, ["a"], "record_id"), "term", "n_rows", "n_records", "mark") == [("x", 2, 1, "rare")]


ENTRIES = [("SODIUM_CHLORIDE", ["sodium chloride", "NaCl"]), ("SODIUM_SULFATE", ["sodium sulfate", "Na2SO4"]), ("PEG_400", ["PEG 400", "polyethylene glycol 400"]), ("PEG_4000", ["PEG 4000", "polyethylene glycol 4000"]), ("PEG_MME_2000", ["PEG MME 2000", "PEG 2000 MME"]), ("MES", ["MES", "mes buffer"]), ("BIS_TRIS", ["Bis-Tris", "bis tris buffer"]), ("BIS_TRIS_PROPANE", ["Bis-Tris propane"]), ("MAGNESIUM_ACETATE", ["magnesium acetate", "Mg(OAc)2"])]


@pytest.mark.parametrize("name,want", [
    ("0.2 M sodium chloride", "SODIUM_CHLORIDE"), ("NaCl (sterile), in mM", "SODIUM_CHLORIDE"), ("chlorure de sodium", "SODIUM_CHLORIDE"), ("Natriumchlorid", "SODIUM_CHLORIDE"), ("soodium chlorde", "SODIUM_CHLORIDE"), ("sulfate, sodium", "SODIUM_SULFATE"),
    ("P.E.G. 4,000", "PEG_4000"), ("peg4k", "PEG_4000"), ("polyethyleneglycol 400", "PEG_400"), ("PEG 40000", None), ("peg 2000 mme", "PEG_MME_2000"), ("Bis-Tris propane*", "BIS_TRIS_PROPANE"), ("bistris", "BIS_TRIS"), ("MES-NaOH", "MES"), ("Mg+ acetate", "MAGNESIUM_ACETATE"),
    ("Mg(OAc)2", "MAGNESIUM_ACETATE"), ("nanobody QT-1", None), ("n/a", None), ("reservoir", None), ("12345", None), ("", None), ("x" * 100_000, None),
])
def test_reagent_names(name, want):
    assert reagent_mapping.Matcher([(c, n) for c, n in ENTRIES]).match(name) == want


def test_reagent_mapping_on_labelled_rows(spark, data):
    components, reagents = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("components", "reagents"))
    known = components.join(reagents.select(F.col("canonical_id").alias("name_canonical")), "name_canonical", "left_semi").withColumn("truth", F.col("name_canonical"))
    mapped = reagent_mapping.map_names(known.withColumn("name_canonical", F.lit(None).cast("string")), "component_id", "name_raw", "name_canonical", reagents)
    joined = mapped.join(known.select("component_id", "truth"), "component_id")
    right, n = joined.agg(F.count_if(F.col("canonical_id") == F.col("truth")), F.count(F.lit(1))).first()
    assert n > 100 and right >= 0.98 * n
    assert reagent_mapping.map_names(components.limit(0), "component_id", "name_raw", "name_canonical", reagents).count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, " ", None), (3, "NaCl", "SODIUM_CHLORIDE"), (4, "nacl", "sodium_chloride")], "component_id bigint, name_raw string, name_canonical string")
    assert rows(reagent_mapping.map_names(odd, "component_id", "name_raw", "name_canonical", reagents), "component_id", "canonical_id") == [(4, "SODIUM_CHLORIDE")]


def _groups(data):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, p, c in data:
        find(("r", i))
        if p and p.strip():
            parent[find(("r", i))] = find(("p", p.strip().upper()))
        if c and c.strip():
            parent[find(("r", i))] = find(("c", c))
    groups = defaultdict(list)
    for i, p, c in data:
        groups[find(("r", i))].append((i, p, c))
    return groups.values()


def test_related_groups_and_splits(spark, recipes):
    rng = random.Random(9)
    chain = [(1000 + i, f"p{i // 2}", f"z{(i + 1) // 2:03d}") for i in range(60)]
    more = [(2000 + i, rng.choice([None, " ", f"q{rng.randrange(40)}", f" Q{rng.randrange(40)} "]), rng.choice([None, "", "hub", "hub", f"w{rng.randrange(30)}"])) for i in range(200)]
    data = [*[(r["record_id"], r["pdb_id"], r["cluster_30"]) for r in recipes.collect()], *chain, *more]
    df = spark.createDataFrame([(*d, "clash", 3) for d in data], "record_id bigint, pdb_id string, cluster_30 string, group_key string, n bigint")
    want = {}
    for g in _groups(data):
        if len(g) > 1:
            clusters = [c for _, _, c in g if c and c.strip()]
            key = min(clusters) if clusters else min(p.strip().upper() for _, p, _ in g if p and p.strip())
            want |= {i: key for i, _, _ in g}
    assert dict(rows(related_splits.related_groups(df, "record_id", "cluster_30", "pdb_id"), "record_id", "group_key")) == want
    split = {r["record_id"]: r["split"] for r in related_splits.split_records(df, "record_id", "cluster_30", "pdb_id", queries.SPLIT_SHARES).collect()}
    assert len(split) == len(data) and set(split.values()) <= set(queries.SPLIT_SHARES)
    for g in _groups(data):
        assert len({split[i] for i, _, _ in g}) == 1
    assert related_splits.related_groups(df.limit(0), "record_id", "cluster_30", "pdb_id").count() == 0
    assert related_splits.split_records(df.limit(0), "record_id", "cluster_30", "pdb_id", queries.SPLIT_SHARES).count() == 0


def test_split_shares_are_near(spark):
    df = spark.createDataFrame([(i, f"p{i}", f"c{i // 4}" if i > 300 else "hub") for i in range(4000)], "record_id bigint, pdb_id string, cluster_30 string")
    n = Counter(r["split"] for r in related_splits.split_records(df, "record_id", "cluster_30", "pdb_id", queries.SPLIT_SHARES).collect())
    for name, share in queries.SPLIT_SHARES.items():
        assert abs(n[name] / 4000 - share) < 0.003


@pytest.fixture(scope="module")
def automaton():
    return tokenizer_automaton.compiled(tokenizer_automaton.vocabulary_path())


def test_automaton_against_a_public_library(automaton, spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(tokenizer_automaton.vocabulary_path())
    reference.encode_special_tokens = True
    rng = random.Random(0)
    texts = ["", "a" * 3000, "\x1c \x1d x", "日本語テキスト" * 20, "<|endoftext|> x", "　 \xa0 x\n\n\n y", "100000 20000 00056982187", "don't I'LL we've", " " * 300 + "x", "🙂🙃" * 9, "ﬁ ½ ²"]
    texts += ["".join(rng.choice("abcdeAB \n\t'.,12039éß漢🙂-_") for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    texts += [b"".join(rng.choice(automaton.tokens) for _ in range(4)).decode("utf-8", "ignore") for _ in range(1500)]
    texts += [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r["text"]]
    for t in texts:
        ids = automaton.encode(t)
        assert ids == reference.encode(t, add_special_tokens=False).ids, t[:60]
        assert automaton.decode(ids) == t


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello hello", "x")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokenizer_automaton.encode_texts(df, "doc_id", "text").collect()}
    assert got[1] == got[2] == [] and len(got[3]) == 2
    back = tokenizer_automaton.decode_ids(tokenizer_automaton.encode_texts(df, "doc_id", "text"), "doc_id", "ids")
    assert rows(back, "doc_id", "text") == [(1, ""), (2, ""), (3, "hello hello")]
    assert rows(tokenizer_automaton.token_counts(df, "doc_id", "text"), "doc_id", "n_tokens") == [(1, 0), (2, 0), (3, 2)]
    assert tokenizer_automaton.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_dominating_pairs_are_optimal():
    import itertools

    def fewest(items, capacity):
        best = len(items)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= capacity:
                    bins[i] += items[k]
                    place(k + 1, bins)
                    bins[i] -= items[k]
            place(k + 1, [*bins, items[k]])

        place(0, [])
        return best

    rng = random.Random(6)
    for _ in itertools.repeat(None, 60):
        items = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))), reverse=True)
        patterns, fixed = containers.plan_containers(Counter(items), 20)
        used = Counter()
        for p, n in patterns:
            assert sum(s * k for s, k in p.items()) <= 20
            for s, k in p.items():
                used[s] += k * n
        assert used == Counter(items)
        assert fixed <= sum(n for _, n in patterns) <= fewest(items, 20) + (1 if fixed < sum(n for _, n in patterns) else 0)


def test_fill_containers(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([50, 50, 50, rng.randrange(1, 90), 100, 101, 777]), "clash") for i in range(2000)] + [(3000, 0, "x"), (3001, None, "x"), (3002, 10_000, "x")]
    df = spark.createDataFrame(sizes, "doc_id bigint, n int, part string")
    placed = containers.fill_containers(df, "doc_id", "n", 100).collect()
    by_doc, by_container = defaultdict(list), defaultdict(list)
    for r in placed:
        by_doc[r["doc_id"]].append(r)
        by_container[r["container_id"]].append((r["start"], r["n_tokens"]))
    for i, n, _ in sizes:
        parts = sorted(by_doc.get(i, []), key=lambda r: r["part"])
        assert sum(r["n_tokens"] for r in parts) == (n or 0)
        assert len(parts) == -(-(n or 0) // 100) and all(r["n_tokens"] == 100 for r in parts[:-1])
    for spans in by_container.values():
        spans.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= 100
    lower = -(-sum(n or 0 for _, n, _ in sizes) // 100)
    assert len(by_container) <= 1.02 * lower
    assert containers.fill_containers(df.limit(0), "doc_id", "n", 100).count() == 0


NAMES = personal_data.Names({"ulla", "oskar"}, {"testmark", "de la probe"})


@pytest.mark.parametrize("text,want", [
    ("Mail ulla+x (at) lab[dot]example now", [("email", "ulla+x (at) lab[dot]example")]), ("x at lab dot group dot test, ok", [("email", "x at lab dot group dot test")]), ("cc: <Ulla@lab.test>; set up @ 5 C", [("email", "Ulla@lab.test")]),
    ("&lt;а.b@lab.test&gt;", [("email", "а.b@lab.test")]), ("Call (+44 20 7946 0001) or 020 7946 0002.", [("phone", "+44 20 7946 0001"), ("phone", "020 7946 0002")]), ("ring (212) 555-0100, 030/23125-100", [("phone", "(212) 555-0100"), ("phone", "030/23125-100")]),
    ("zero two zero seven nine four six zero zero zero one", [("phone", "zero two zero seven nine four six zero zero zero one")]), ("Plate barcode 00123456789, batch 1234-567-89, cell 57.0 107.1 229.8 90 90 90", []),
    ("DNI: 99123456A; passport no. ZZ 1234567; NIR 399339912345678", [("id_number", "99123456A"), ("id_number", "ZZ 1234567"), ("id_number", "399339912345678")]), ("goes to Flat 2, 14 Heron Road, Marrowby. We", [("address", "Flat 2, 14 Heron Road, Marrowby")]),
    ("Ahornweg 12a und 9 rue des Prés, 00123 Montval", [("address", "Ahornweg 12a"), ("address", "9 rue des Prés, 00123 Montval")]), ("C/ Olmo 3, 00100 Villa", [("address", "C/ Olmo 3, 00100 Villa")]),
    ("Dr. Testmark and O.U. Testmark saw Mme de la Probe", [("name", "Testmark"), ("name", "O.U. Testmark"), ("name", "de la Probe")]), ("TESTMARK, ULLA noted; at 289 K. Testmark too", [("name", "TESTMARK, ULLA"), ("name", "Testmark")]), ("Thanks to Berta Newname for it", [("name", "Berta Newname")]), ("The Matthews coefficient", []), ("", []), (None, []),
])
def test_mentions(text, want):
    assert [(k, text[a:b]) for k, a, b in personal_data.find_mentions(text, NAMES)] == want


def test_rewriting_keeps_places():
    for source in ("а (at) b [dot] c &lt;x&gt; \xa0 ﬁn", "one two three four five six x at y dot z", "plain"):
        plain = personal_data.Plain(source)
        if plain.starts is not None:
            assert len(plain.text) == len(plain.starts) == len(plain.ends) and all(0 <= a < b <= len(source) for a, b in zip(plain.starts, plain.ends))


def test_mentions_are_linear_in_length():
    for text in ("a" * 200_000, "@" * 5000, "(" * 20_000 + " at ", "1 " * 50_000, "x@y " * 5000, "A. " * 30_000, "Testmark " * 20_000):
        personal_data.find_mentions(text, NAMES)


def test_mention_rows_and_redaction(spark):
    texts = [None, "", "   ", "Thanks to Berta Newname for it. Mail b@lab.test", "Thanks to Berta Newname for it. Mail b@lab.test", "BERTA NEWNAME was here"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, kind string")
    got = rows(personal_data.mentions(df, "doc_id", "text"), "doc_id", "kind", "start_pos", "end_pos")
    assert got == [(3, "email", 37, 47), (3, "name", 10, 23), (4, "email", 37, 47), (4, "name", 10, 23), (5, "name", 0, 13)]
    safe = {r["doc_id"]: r["text"] for r in personal_data.redact(df, "doc_id", "text").collect()}
    assert safe[0] is None and safe[1] == "" and safe[3] == "Thanks to [NAME] for it. Mail [EMAIL]"
    assert personal_data.mentions(df.limit(0), "doc_id", "text").count() == 0


def test_names_of_several_abbreviated_words():
    m = reagent_mapping.Matcher([("AMMONIUM_SULFATE", ["ammonium sulfate"]), ("POTASSIUM_NITRATE", ["potassium nitrate"]), ("GLYCEROL", ["glycerol"])])
    assert [m.match(n) for n in ("ammo. sulf.", "pota. nitr.", "pota. nitrate", "zzzz. yyyy.")] == ["AMMONIUM_SULFATE", "POTASSIUM_NITRATE", "POTASSIUM_NITRATE", None]


def test_names_introduced_in_one_text_only_count_there():
    text = "Thanks to Berta Newname for it. Later Newname wrote to B. Newname; see Newname, Berta."
    assert [text[a:b] for _, a, b in personal_data.find_mentions(text, NAMES)] == ["Berta Newname", "Newname", "B. Newname", "Newname, Berta"]
    assert personal_data.find_mentions("Later Newname wrote", NAMES) == []


def test_more_names_than_are_broadcast_give_the_same_mentions(spark, monkeypatch):
    people = ["Berta Newname", "Oskar de la Probe", "Ulla von Testmark", "Jan la Marke", "Eva-Lotte Muster"]
    texts = [f"Thanks to {p} for it." for p in people for _ in range(2)]
    texts += [x for p in people for g, _, s in [p.partition(" ")] for x in (f"{g.upper()} {s.upper()} was here, {s}, {g} too", f"then {g[0]}.K. {s} and {g} X. {s}; mail x@{s.split()[-1]}.test", f"de {s}: {s}")]
    texts += [None, "", "  ", "Thanks to Olaf Einmal for it. Einmal again", "Einmal alone", texts[-1], texts[-1]]
    df = spark.createDataFrame([(i % 30, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = lambda: rows(personal_data.mentions(df, "doc_id", "text"), "doc_id", "kind", "start_pos", "end_pos")
    safe = lambda: sorted(map(str, personal_data.redact(df, "doc_id", "text").collect()))
    want, want_safe = found(), safe()
    monkeypatch.setattr(personal_data, "MAX_NAMES", 1)
    assert found() == want and safe() == want_safe and len(want) > 40


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, data, name):
    assert_same(queries.QUERIES[name](spark, data), database(data), queries.ORACLES[name])


COLUMNS = {
    "p2_found": ["record_id bigint", "n_copies bigint"], "p3_found": ["record_id_a bigint", "record_id_b bigint"], "p4_found": ["field string", "term string", "n_rows bigint", "n_records bigint", "mark string"],
    "p5_found": ["component_id bigint", "canonical_id string"], "p6_found": ["record_id bigint", "group_key string"], "p8_ids": ["doc_id bigint", "ids array<int>"],
    "p10_found": ["doc_id bigint", "kind string", "start_pos int", "end_pos int"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    if name in COLUMNS:
        assert [f"{c} {t}" for c, t in df.dtypes] == COLUMNS[name]
    assert df.count() > 0


def _fewest(items, capacity):
    """The least number of containers, over all subsets of at most nine items."""
    states = [(0, capacity)] + [(99, 0)] * ((1 << len(items)) - 1)
    for m, (n, load) in enumerate(states):
        for i, size in enumerate(items):
            if not m >> i & 1:
                states[m | 1 << i] = min(states[m | 1 << i], (n, load + size) if load + size <= capacity else (n + 1, size))
    return states[-1][0]


def test_fixed_containers_never_cost_one_and_the_rest_is_best_fit():
    rng = random.Random(5)
    for _ in range(4000):
        capacity = rng.randrange(10, 41)
        items = [rng.randrange(1, capacity + 1 if rng.random() < 0.6 else capacity // 2 + 1) for _ in range(rng.randrange(1, 9))]
        rest = dict(Counter(items))
        fixed = sum(n for _, n in containers._reduce(rest, capacity))
        left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
        assert fixed + _fewest(left, capacity) == _fewest(items, capacity), (capacity, items)
        loads: list[int] = []
        for s in left:
            fitting = [b for b in loads if b + s <= capacity]
            if fitting:
                loads.remove(max(fitting))
            loads.append(max(fitting, default=0) + s)
        patterns, n_fixed = containers.plan_containers(Counter(items), capacity)
        assert n_fixed == fixed and sum(n for _, n in patterns) == fixed + len(loads)
    assert containers.dominating(10, {10: 1, 8: 1, 3: 3}, 20) is None  # three of size 3 take more than the 8


def test_large_histograms_are_planned_near_the_lower_bound():
    rng = random.Random(3)
    histogram = Counter({s: rng.randrange(1, 10**6) for s in rng.sample(range(1, 2049), 1500)})
    patterns, _ = containers.plan_containers(histogram, 2048)
    used = Counter()
    for p, n in patterns:
        assert sum(s * k for s, k in p.items()) <= 2048
        for s, k in p.items():
            used[s] += k * n
    large = sum(n for s, n in histogram.items() if 2 * s > 2048)
    assert used == histogram and sum(n for _, n in patterns) <= 1.01 * max(large, sum(s * n for s, n in histogram.items()) / 2048)


def test_spans_of_all_maximal_matches_add_up_to_what_is_shared():
    rng = random.Random(11)
    sequences = [sorted(rng.sample(range(1, 30), rng.randrange(1, 15))) for _ in range(60)]
    patterns = [sorted(rng.sample(range(1, 34), rng.randrange(1, 15))) for _ in range(40)]
    # indexed from the last symbol to the first: the search goes on to the next symbols
    index = backward_index.BackwardIndex(np.concatenate([s[::-1] for s in sequences]), np.array([len(s) for s in sequences]))
    matrix = np.full((len(patterns), 15), -1)
    for i, p in enumerate(patterns):
        matrix[i, : len(p)] = [x if x < 30 else -1 for x in p]
    got: dict = defaultdict(list)
    for p, s, n in zip(*(x.tolist() for x in index.maximal_matches(matrix, np.array([len(p) for p in patterns]), anywhere=True))):
        got[p, s].append(n)
    for p, pattern in enumerate(patterns):
        for s, sequence in enumerate(sequences):
            runs, last = [], (-2, -2)
            for x in sorted(set(pattern) & set(sequence)):
                here = (pattern.index(x), sequence.index(x))
                if here == (last[0] + 1, last[1] + 1):
                    runs[-1] += 1
                else:
                    runs.append(1)
                last = here
            assert sorted(got[p, s]) == sorted(runs)


def test_overlap_report_counts_pairs_and_spans(spark, monkeypatch):
    texts = ["alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon zeta", "alpha beta gamma delta", "one two", "two, one", None, "", "eta theta"]
    rows_ = [(i, t, "E1" if i in (3, 7) else None, "train" if i % 2 else "val" if i < 6 else "test", "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows_ + [(i, "hot word set", None, "train" if i % 3 else "test", "h") for i in range(100, 160)], "record_id bigint, raw_details string, pdb_id string, split string, source string")
    arguments = ("record_id", "raw_details", "pdb_id", "split", "source")
    report = lambda: rows(split_overlap.overlap_report(df, *arguments), "split", "source", "n_pairs", "n_records", "longest")
    want = report()
    assert ("test", "h", 20 * 40, 20, 3) in want and ("val", "s", 2, 2, 5) in want
    monkeypatch.setattr(split_overlap, "BLOCK", 7)  # classes above seven records are joined in blocks
    assert report() == want


#: Phrase forms that no row of the test tables has, and names that only qualify another.
HELD_OUT = [
    "{} in water", "{} used as cryoprotectant", "0.2 M {} from Sigma", "stock of {} dissolved in water", "crude {}", "lab-made {} for the soak", "{} mit Wasser", "solution de {} pour le bain", "{} con agua", "Merck {} with glass beads", "{} obtained from plants",
    "2 ml of {} on ice", "commercial {} without preservative", "{} weighed by hand", "20 mM {} into the drop",
]
DECOYS = ["{} kinase", "{} inhibitor", "{} phosphatase", "{} antibody", "{} receptor"]


def test_embedded_mentions_in_phrases_the_tables_do_not_have(spark, data):
    reagents = spark.read.parquet(f"{data}/reagents.parquet").orderBy("canonical_id").collect()
    m = reagent_mapping.Matcher([(r["canonical_id"], [r["display_name"], *(r["aliases"] or []), r["canonical_id"]]) for r in reagents])
    names = [(r["canonical_id"], r["display_name"]) for r in reagents]
    right = Counter(m.match(form.format(name)) == cid for cid, name in names for form in HELD_OUT)
    assert right[True] >= 0.95 * right.total(), right
    wrong = Counter(m.match(form.format(name)) is None for _, name in names for form in DECOYS)
    assert wrong[True] >= 0.9 * wrong.total(), wrong
    rng, typos = random.Random(4), Counter()
    for cid, name in names:  # names written with one letter dropped, doubled or swapped
        if len(name) > 7:
            for _ in range(6):
                k = rng.randrange(1, len(name) - 1)
                if name[k].isalpha() and name[k + 1].isalpha():
                    typos[m.match(rng.choice([name[:k] + name[k + 1 :], name[:k] + name[k] * 2 + name[k + 1 :], name[:k] + name[k + 1] + name[k] + name[k + 2 :]])) == cid] += 1
    assert typos[True] >= 0.9 * typos.total(), typos
    print(right, wrong, typos)


#: Ways of naming a person that no text of the test tables uses, with and without evidence in the same text.
HELD_OUT_PEOPLE = [
    "The drops dried out.\nBest regards,\n{g} {s}", "Dr. {s} checked the tray again.", "ask Prof. {g} {s}, please", "{g} {s} <{lg}.{ls}@lab.test> has the key", "write to {lg}{ls}@lab.test, then {g} {s} answers",
    "{g} {s} ({i}{ls}@lab.test) was late", "Viele Grüße\n{g} {s}", "Cordialement,\n{g} {s}\n", "Un saludo, {g} {s}", "Mrs. {s} left; Cheers, {g} {s}",
]
#: The same without any evidence in the text: found if two other texts introduce the given name or the surname.
HELD_OUT_PLAIN = ["yesterday {g} {s} looked at the drops", "{g} {s} will call back", "the key is with {s}", "{s}, {g} has the list", "asked {i}. {s} about it"]


def test_people_in_phrases_the_tables_do_not_have():
    rng = random.Random(12)
    make = lambda: "".join(rng.choice(["bar", "lo", "vin", "tes", "kor", "mi", "dal", "un", "sen", "ra"]) for _ in range(3)).capitalize()
    right = Counter()
    for form in HELD_OUT_PEOPLE:
        for _ in range(20):
            g, s = make(), make()
            text = form.format(g=g, s=s, lg=g.lower(), ls=s.lower(), i=g[0].lower())
            got = [text[a:b] for k, a, b in personal_data.find_mentions(text, NAMES) if k == "name"]
            want = re.findall(rf"{g} {s}|(?<=Dr\. ){s}|(?<=Mrs\. ){s}", text)
            right[got == want] += 1
    assert right[True] >= 0.95 * right.total(), right
    known = [(make(), make()) for _ in range(40)]
    lexicon = personal_data.Names({g.lower() for g, _ in known}, {s.lower() for _, s in known})
    plain = Counter()
    for form in HELD_OUT_PLAIN:
        for g, s in known:
            text = form.format(g=g, s=s, i=g[0])
            got = [text[a:b] for k, a, b in personal_data.find_mentions(text, lexicon)]
            plain[len(got) == 1 and s in got[0] and (g in got[0] or g not in text)] += 1
            new = make()  # a surname nobody introduced, behind a known given name
            text = f"today {g} {new} came"
            plain[[text[a:b] for _, a, b in personal_data.find_mentions(text, lexicon)] == [f"{g} {new}"]] += 1
    assert plain[True] >= 0.95 * plain.total(), plain
    for text in ("The Plate was cold. Best results at 4 C", "Prof. wrote", "Regards to all of them", "mail data.collection@x.test for data collection"):
        assert not [k for k, _, _ in personal_data.find_mentions(text, NAMES) if k == "name"]
    print(right, plain)


def test_contraction_in_one_task_and_by_joins_give_the_same_components(spark, monkeypatch):
    rng = random.Random(17)
    edges = [(f"v{i}", f"v{i + 1}") for i in range(70)] + [("hub", f"h{i}") for i in range(60)] + [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(45)]
    df = spark.createDataFrame(edges, "a string, b string")

    def components():
        groups = defaultdict(set)
        for r in related_splits.contract(df).collect():
            groups[r["label"]].add(r["vertex"])
        assert all(label in g for label, g in groups.items())
        return sorted(map(sorted, groups.values()))

    want = components()
    assert sorted(len(g) for g in want)[-2:] == [61, 71] and sum(map(len, want)) == len({x for a, b in edges if a != b for x in (a, b)})
    monkeypatch.setattr(related_splits, "SMALL_GRAPH", 100)  # some rounds by joins first, unwound afterwards
    assert components() == want
    assert related_splits.contract(df.limit(0)).count() == 0
