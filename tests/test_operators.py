"""Operators on small frames: nulls, empties, ties, repeated rows, order independence, round trips through sources and sinks."""

from __future__ import annotations

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from brineflow.functions.clauses import head_name
from brineflow.operators import assign, corpus, evaluation, flatten, graph, joins, link, packed, parse, release, sampling, screens, sequence, units, vectors
from brineflow.runtime import manifest
from brineflow.schemas import RAW_ENTRY
from brineflow.sources import readers, services, sinks
from brineflow.streaming import incremental

REAGENTS = [
    ("SODIUM_CHLORIDE", "sodium chloride", "salt", ["nacl"], "molar", None, None), ("PEG_4000", "PEG 4000", "peg", ["polyethylene glycol 4000"], "percent_w_v", 4000, None),
    ("MOPS", "MOPS", "buffer", ["mops buffer"], "molar", None, 7.2), ("GLYCEROL", "glycerol", "polyol", [], "percent_v_v", None, None), ("LITHIUM_SULFATE", "lithium sulfate", "salt", None, "molar", None, None),
]


@pytest.fixture(scope="module")
def reagents(spark):
    return spark.createDataFrame([(*r[:5], r[5], False, r[6]) for r in REAGENTS], "canonical_id string, display_name string, chem_class string, aliases array<string>, default_unit string, peg_mw int, is_mme boolean, buffer_pka double")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# packed values

CASES = [
    ('"a, 5 mM"; b 1 M', ["a, 5 mM", "b 1 M"]), ("1) x 1 M 2) y (2 mM, z) 3) w 3%", ["x 1 M", "y (2 mM, z)", "w 3%"]), ("a 0,5 M, b 1,5 M", ["a 0,5 M", "b 1,5 M"]),
    ("a 1 M / b mol/l 2 / c-d 3 M.", ["a 1 M", "b mol/l 2", "c-d 3 M"]), ("", []), (None, []), (" \n ", []), ('"say ""5 mM"""; b 1 M', ['say "5 mM"', "b 1 M"]),
    ("'a, 5 mM'\t'b  1 M'", ["a, 5 mM", "b 1 M"]), (", a 1 M ;; b 2 M |", ["a 1 M", "b 2 M"]), ("* a 1 M\n* b 2 M", ["a 1 M", "b 2 M"]), ("a (1 M, b 2 M", ["a (1 M", "b 2 M"]),
    ("(i) a 1 M (ii) b 2 M", ["a 1 M", "b 2 M"]), ("a 1 M and b 2 M plus c 3 M", ["a 1 M", "b 2 M", "c 3 M"]),
]
ACCEPTED = frozenset(packed.CANDIDATES) - {"colon", "word_at", "word_in", "stop"}


@pytest.mark.parametrize("text,want", CASES)
def test_split_values(text, want):
    assert packed.split_values(text, ACCEPTED) == want


def test_split_is_linear_in_length():
    for text in ("(" * 50_000, '"' * 50_001, "a 1 M; " * 50_000, "1) " * 20_000, "x" * 200_000, ", " * 100_000):
        assert isinstance(packed.split_values(text, ACCEPTED), list)


def test_packed_rows(spark):
    texts = ["kbr 1 M; mops 5 mM", None, "", "one value 5 mM", "kbr 1 M; mops 5 mM"] + [f"potassium nitrate {i} mM; base buffer {i} M; tray code ab{i}xyz" for i in range(50)]
    df = spark.createDataFrame([(i, t, None if i % 9 == 0 else "s", "clash", 1) for i, t in enumerate(texts)], "record_id bigint, raw_details string, source string, value string, position int")
    out = packed.explode_values(df, "record_id", "raw_details", "source")
    assert out.columns == ["record_id", "position", "value"]
    got = [r for r in rows(out, "record_id", "position", "value") if r[0] < 5]
    assert got == [(0, 1, "kbr 1 M"), (0, 2, "mops 5 mM"), (4, 1, "kbr 1 M"), (4, 2, "mops 5 mM")]
    assert rows(packed.explode_values(df.repartition(7), "record_id", "raw_details", "source"), "record_id", "position", "value") == rows(out, "record_id", "position", "value")
    assert packed.explode_values(df.limit(0), "record_id", "raw_details", "source").count() == 0
    assert packed.delimiter_scores(df, "raw_details", "source").where("accepted").count() >= 1


def test_canonical_content():
    a, b = packed.canonical_content("Kbr 1.5 M; mops-X", ACCEPTED), packed.canonical_content('"MOPS X", "kbr  (1.5 m)"', ACCEPTED)
    assert a == b
    assert packed.canonical_content("kbr 1,5 M", ACCEPTED) != packed.canonical_content("kbr 1.5 M", ACCEPTED)
    assert packed.canonical_content("a; a", ACCEPTED) != packed.canonical_content("a", ACCEPTED)


# units

UNITS = [
    ("mM", ("nanomolar", 1e6)), ("mmol l-1", ("nanomolar", 1e6)), ("10^-3 M", ("nanomolar", 1e6)), ("milli molar", ("nanomolar", 1e6)), ("µM", ("nanomolar", 1e3)), ("mol dm-3", ("nanomolar", 1e9)),
    ("% (wt/vol)", ("ug_ml", 1e4)), ("g/100 ml", ("ug_ml", 1e4)), ("µg/µl", ("ug_ml", 1e3)), ("gram per litre", ("ug_ml", 1e3)), ("vol.-%", ("ppm_v_v", 1e4)), ("ml/l", ("ppm_v_v", 1e3)),
    ("%", None), ("", None), (None, None), ("unitless", None), ("percent_unspecified", None), ("furlong", None), ("K", ("kelvin", 1.0)),
]


@pytest.mark.parametrize("text,want", UNITS)
def test_units(text, want):
    found = units.common(units.parse_unit(text))
    assert (found and (found[0], pytest.approx(found[1]))) == want


def test_temperature_scales_have_offsets():
    name, scale, shift = units.common(units.parse_unit("°F"))
    assert name == "kelvin" and 32 * scale + shift == pytest.approx(273.15)


@pytest.mark.parametrize("name,want", [("0.2 M kbr", "nanomolar"), ("kbr (mM)", "nanomolar"), ("peg 400, in % (v/v)", "ppm_v_v"), ("% w/v peg 4000", "ug_ml"), ("jeffamine M-600", None), ("K acetate", None), ("kbr (sterile)", None), ("kbr", None)])
def test_units_in_names(name, want):
    found = units.common(units.unit_in_name(name))
    assert (found and found[0]) == want


def test_convert(spark):
    data = [(1, 5.0, "mM", False, "x"), (2, 5.0, None, None, "kbr (M)"), (3, 5.0, "mM", True, "kbr (M)"), (4, None, "mM", False, "x"), (5, float("nan"), "mM", False, "x"), (6, 5.0, "%", False, "kbr (M)"), (7, 2.0, "mM", True, None)]
    df = spark.createDataFrame([(*d, "clash") for d in data], "component_id bigint, n double, unit string, guessed boolean, name string, common_unit string")
    got = rows(units.convert(df, "component_id", "n", "unit", "guessed", "name"), "component_id", "common_unit", "amount")
    assert got == [(1, "nanomolar", 5_000_000), (2, "nanomolar", 5_000_000_000), (3, "nanomolar", 5_000_000_000), (7, "nanomolar", 2_000_000)]
    assert units.convert(df.limit(0), "component_id", "n", "unit", "guessed", "name").count() == 0


# joins, graph, linkage


def test_heavy_light_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k6", 3)], "k string, v int")
    for how in ("left", "inner"):
        assert rows(joins.heavy_light_join(left, right, "k", how).na.fill(0), "i", "v") == rows(left.join(right, "k", how).na.fill(0), "i", "v")


def test_components_match_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(90)] + [("n1", f"m{i}") for i in range(60)] + [(f"p{i}", f"p{i + 1}") for i in range(40)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    groups: dict = {}
    for n in parent:
        groups.setdefault(find(n), []).append(n)
    want = sorted((n, min(g)) for g in groups.values() for n in g)
    df = spark.createDataFrame(edges, "a string, b string")
    assert rows(graph.connected_components(df), "node", "component") == want
    assert rows(graph.connected_components(df.repartition(5)), "node", "component") == want
    assert graph.connected_components(df.limit(0)).count() == 0


def test_sequence_clusters_recall(spark):
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(160)) for _ in range(25)]
    seqs = [(f"{i:02d}_{j}", s if j == 0 else s[:80] + "W" + s[81:] if j == 1 else s) for i, s in enumerate(base) for j in range(3)]
    df = spark.createDataFrame([*seqs, ("none", None), ("short", "AC")], "id string, s string")
    got = dict(rows(link.cluster_sequences(df, "id", "s", 0.5), "id", "cluster"))
    together = sum(got[f"{i:02d}_0"] == got[f"{i:02d}_1"] == got[f"{i:02d}_2"] for i in range(25))
    assert together >= 0.9 * 25 and len(set(got.values())) >= 25 and len(got) == 77


def test_clusters_of_families_near_the_similarity_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(link, "CELL", 3, raising=False)  # many cells a bucket
    rng = random.Random(5)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    seqs = {}
    for f in range(12):
        base = [rng.choice(letters) for _ in range(200)]
        for j in range(12):
            s = list(base)
            for i in rng.sample(range(200), 6 + f % 6):
                s[i] = rng.choice(letters)
            seqs[f"{f:02d}_{j:02d}"] = "".join(s)
    shingles = {k: {s[i : i + 5] for i in range(len(s) - 4)} for k, s in seqs.items()}
    alike = [(a, b) for a in seqs for b in seqs if a < b and len(shingles[a] & shingles[b]) >= 0.5 * len(shingles[a] | shingles[b])]
    df = spark.createDataFrame(list(seqs.items()), "id string, s string")
    got = dict(rows(link.cluster_sequences(df, "id", "s", 0.5), "id", "cluster"))
    pairs = set(rows(link.similar_sequences(df, "id", "s", 0.5), "a", "b"))
    assert pairs <= set(alike) and len(pairs) >= 0.9 * len(alike)
    assert sum(got[a] != got[b] for a, b in alike) <= 0.01 * len(alike)  # the bands themselves miss few
    assert all(a[:2] == b[:2] for a in seqs for b in seqs if got[a] == got[b])


@pytest.mark.parametrize("most_sent", [100_000, 1])
def test_close_matches_are_those_of_all_pairs(spark, monkeypatch, most_sent):
    import difflib

    monkeypatch.setattr(corpus, "MOST_SENT", most_sent, raising=False)
    names = ["mm fresh nicotinamide adenine dinucleotide", "m sodium fluuoridde", "prroline", "xsodium fluoride", "sodium fluoride 7", "peg 400", "peg 4000", "zzz", None]
    known = ["nicotinamide adenine dinucleotide", "sodium fluoride", "l proline", "peg 4000", "peg 400", "peg 8000", "sodium fluoride"]
    want = set()
    for x in filter(None, names):
        scored = sorted((-difflib.SequenceMatcher(None, x, y, autojunk=False).ratio(), y) for y in set(known))
        want |= {(x, y, r) for r, (s, y) in enumerate(scored[:2], 1) if -s >= 0.82}
    found = corpus.close_matches(spark.createDataFrame([(n,) for n in names], "name string"), "name", spark.createDataFrame([(k,) for k in known], "known string"), "known", 0.82, 2)
    assert set(rows(found, "name", "known", "rank")) == want and len(want) > 6


def test_best_ratio_reads_the_whole_text(spark, tmp_path):
    from brineflow.plans import analysis

    spark.createDataFrame([(1, "x" * 1_000_010 + " sodium fluoride")], "record_id bigint, raw_details string").write.parquet(f"{tmp_path}/conditions.parquet")
    spark.createDataFrame([(7, 1, "sodium fluoride", None)], "component_id bigint, record_id bigint, name_raw string, name_canonical string").write.parquet(f"{tmp_path}/components.parquet")
    assert rows(analysis.QUERIES["q_best_ratio"](spark, str(tmp_path)), "component_id", "similarity") == [(7, 1.0)]


def test_units_in_texts_of_any_length():
    long = "x" * 500
    assert units.common(units.unit_in_name(f"{long} (mM)")) == units.common(units.parse_unit("mM"))
    assert units.common(units.unit_in_name(f"10 mg/ml {long}")) == units.common(units.parse_unit("mg/ml"))
    assert units.common(units.parse_unit("m" + " " * 80 + "mol / l")) is None and units.common(units.parse_unit("mmol" + " " * 80 + "/ l")) == units.common(units.parse_unit("mM"))
    assert units.parse_unit("10^999 M") is None and units.parse_unit("9" * 5000 + "^M") is None and units.parse_unit("10^" + "9" * 5000 + " M") is None


def test_queries_over_all_rows_match_brute_force(spark, tmp_path):
    import hashlib
    import re

    from brineflow.functions.text import HYDRATE_WORDS
    from brineflow.plans import analysis, relational

    texts = ["10 mM  Zn\u00fccker, 5 \u00b5M \u2013 Salz", "plain  TEXT", "", None, " \u00c4\u00d6 "]
    spark.createDataFrame(list(enumerate(texts)), "record_id bigint, raw_details string").write.parquet(f"{tmp_path}/conditions.parquet")
    parts = [(1, "glycerol as cryo", "GLYCEROL", "polyol", 30.0, "percent_v_v"), (2, None, "GLYCEROL", "polyol", 10.0, "percent_v_v"), (3, "zinc acetate dihydrate", "ZINC ACETATE DIHYDRATE", "salt", 1.0, "molar")]
    spark.createDataFrame(parts, "component_id bigint, name_raw string, name_canonical string, chem_class string, concentration double, unit string").write.parquet(f"{tmp_path}/components.parquet")
    reagents = [("ZINC_ACETATE", "zinc acetate dihydrate", ["zn salt"], "salt", None), ("ZINC_SALT", "zinc salt", ["zn salt"], "salt", None)]
    spark.createDataFrame(reagents, "canonical_id string, display_name string, aliases array<string>, chem_class string, peg_mw int").write.parquet(f"{tmp_path}/reagents.parquet")
    run = lambda m, q, *c: rows(m.QUERIES[q](spark, str(tmp_path)), *c)
    key = lambda x: " ".join(re.sub(rf"\b(?:{HYDRATE_WORDS})\b", " ", x.lower()).split())

    want = []
    for i, x in enumerate(texts):
        x = None if x is None else x.strip(" ")
        want.append((i, not x, None if x is None else len(re.sub("[^a-z0-9]", "", x.lower())), None if x is None else hashlib.sha256(re.sub(r"\s+", " ", x).lower().encode()).hexdigest()[:16]))
    assert run(relational, "q_text_keys_all", "record_id", "blank", "n_alnum", "key_digest") == want
    assert run(relational, "q_roles_all", "component_id", "cryo") == [(1, "explicit"), (2, "inferred"), (3, None)]
    assert run(relational, "q_id_builders_all", "canonical_id", "built_id", "words") == [(r[0], r[1].upper().replace(" ", "_"), key(r[1])) for r in reagents]
    assert run(analysis, "q_merged_queue_all", "key", "name", "weight", "is_proposal") == [("glycerol", "GLYCEROL", 2, False), ("zinc acetate", "zinc acetate dihydrate", 1, True), ("zinc salt", "zinc salt", 1, True)]
    assert run(analysis, "q_lexicon_violations_all", "rule", "canonical_ids") == [("alias_owned_twice", ["ZINC_ACETATE"]), ("id_shape", []), ("repeated_id", []), ("weight", [])]


def test_vectors_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], "clash") for i in range(60)] + [(60, None, "x")], "vec_id bigint, e array<double>, target string")
    got = {(r["query"], r["rank"]): r["target"] for r in vectors.nearest_vectors(df.where("vec_id % 20 = 0 AND vec_id < 60"), df, "vec_id", "e", 3).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = u @ u[q]
        s[q] = -9
        assert [got[q, r] for r in (1, 2, 3)] == list(np.argsort(-s)[:3])


def test_reconcile_compare_and_gate(spark):
    a = spark.createDataFrame([("A", "x", 1), ("A", "y", 2), ("B", "x", 1), ("C", None, 1)], "k string, t string, o int")
    b = spark.createDataFrame([("A", "x", 1), ("A", "z", 2), ("B", "x", 1), ("D", "x", 1)], "k string, t string, o int")
    status = dict(rows(link.compare_sources(a, b, "k", "t", "o"), "k", "status"))
    assert status == {"A": "text_mismatch", "B": "agree", "C": "missing", "D": "missing"}
    assert dict(rows(link.reconcile(a, b, ["k"]), "status", "n")) == {"agree": 2, "left_only": 1, "right_only": 1}
    with pytest.raises(ValueError):
        link.gate(link.compare_sources(a, b, "k", "t", "o"), 0.9)


# parser and classification


@pytest.fixture(scope="module")
def parsed(spark, reagents):
    texts = [
        "22% PEG 4000, 0.2 M NaCl, 0.1 M MOPS pH 7.2", "18-22% PEG 4000\n0.3 M lithium sulfate", None, "", "pH 7", "SITTING DROP, temperature 289K", "0.2 M frobnicate, 5 mM widgetol", "25% glycerol, 0.1 M MOPS",
        "5% glycerol, 20% w/v PEG 4000", "20% PEG 4000, 0.1 M mops, pH 6.9", "20% PEG 4000, final pH 7.5", "PROTEIN SOLUTION: 20 mM MOPS pH 6.0. RESERVOIR: 20% PEG 4000", "9000 mM NaCl, 20% PEG 4000", "22% PEG 4000, 0.2 M NaCl, 0.1 M MOPS pH 7.2",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id bigint, raw_details string")
    records, components = parse.parse(df, reagents)
    return {r["record_id"]: r for r in records.collect()}, components.collect()


def of(parsed, text):
    return sorted([c for c in parsed[1] if c["text"] == text], key=lambda c: c["clause_index"])


def test_parsed_components(parsed):
    first = of(parsed, "22% PEG 4000, 0.2 M NaCl, 0.1 M MOPS pH 7.2")
    assert [c["name_canonical"] for c in first] == ["PEG_4000", "SODIUM_CHLORIDE", "MOPS"]
    assert [(c["concentration"], c["unit"], c["unit_inferred"]) for c in first] == [(22.0, "percent_w_v", True), (0.2, "molar", False), (0.1, "molar", False)]
    assert [c["role"] for c in first] == ["precipitant", "salt", "buffer"]
    ranged = of(parsed, "18-22% PEG 4000\n0.3 M lithium sulfate")[0]
    assert (ranged["concentration"], ranged["range_low"], ranged["range_high"]) == (20.0, 18.0, 22.0)
    assert of(parsed, "25% glycerol, 0.1 M MOPS")[0]["cryo_evidence"] is None
    assert of(parsed, "5% glycerol, 20% w/v PEG 4000")[0]["cryo_evidence"] == "inferred"
    assert of(parsed, "9000 mM NaCl, 20% PEG 4000")[0]["concentration"] is None
    assert of(parsed, "PROTEIN SOLUTION: 20 mM MOPS pH 6.0. RESERVOIR: 20% PEG 4000")[-1]["role"] == "precipitant"


def test_parsed_records(parsed):
    r = parsed[0]
    assert len(r) == 14
    assert (r[0]["parsed_ph_text_value"], r[0]["parsed_ph_source"], r[0]["parsed_discard_reason"], r[0]["parsed_parse_confidence"]) == (7.2, "buffer", None, 1.0)
    assert [r[i]["parsed_discard_reason"] for i in (2, 3, 4, 5, 6)] == ["EMPTY", "EMPTY", "TOO_SHORT", "METHOD_ONLY", "NO_REAGENT_MATCH"]
    assert (r[9]["parsed_ph_text_value"], r[9]["parsed_ph_source"]) == (6.9, "buffer")
    assert r[10]["parsed_ph_source"] == "final"
    assert r[5]["parsed_temperature_text"] == 289.0
    assert r[13]["parsed_n_components"] == r[0]["parsed_n_components"]
    assert head_name("22% peg4000") == "peg 4000"


def test_distance_properties(spark):
    def point(**axes):
        return {a: axes.get(a) for a in assign.AXES}

    data = [(1, point(peg_log_mw=3.5, ph=7.0), point(peg_log_mw=3.5, ph=7.0)), (2, point(peg_log_mw=3.5), point(peg_log_mw=4.5)), (3, point(peg_log_mw=4.5), point(peg_log_mw=3.5)), (4, point(ph=7.0), point(peg_log_mw=3.5)), (5, point(ph=7.0), point(ph=8.0))]
    axes = ",".join(f"{a}:double" for a in assign.AXES)
    df = spark.createDataFrame(data, f"i int, a struct<{axes}>, b struct<{axes}>")
    got = {r["i"]: (r["d"], r["s"]) for r in df.select("i", assign.distance("a", "b").alias("d"), assign.shares_axis("a", "b").alias("s")).collect()}
    assert got[1] == (0.0, True) and got[2][0] == got[3][0] == pytest.approx(1.0) and got[4] == (float("inf"), False) and got[5][1] is False


# sampling, evaluation, corpora, sequences


def test_samples_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], f"text number {i} of the small collection") for i in range(100)], "k bigint, s string, t string")
    for draw in (lambda d: sampling.stratified(d, "k", ["s"], 20), lambda d: sampling.frozen_set(d, "k", "t", 10), lambda d: sampling.banded_sample(d, "k", "k", 3, 4)):
        assert rows(draw(df), "k") == rows(draw(df.repartition(6)), "k")
    assert sampling.stratified(df, "k", ["s"], 20).count() <= 20


def test_hold_out_by_key_and_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "A  B"), (3, "c"), (4, None)], "k bigint, t string")
    assert rows(sampling.hold_out(df, df.where("k = 1"), "k", "t"), "k") == [(3,), (4,)]


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    r = evaluation.auc(df, F.col("y") == 1, F.col("s")).first()
    assert r["auc"] == pytest.approx(0.875)


def test_top_k_is_null_where_it_restricts_nothing(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "q string, l string, rank int")
    truth = spark.createDataFrame([("q", "b"), ("z", "a")], "q string, l string")
    got = {r["k"]: (r["accuracy"], r["coverage"]) for r in evaluation.top_k(ranked, truth, "q", "l", [1, 2, 3], 3).collect()}
    assert got == {1: (0.0, 0.5), 2: (0.5, 0.5), 3: (None, 0.5)}


@pytest.mark.parametrize("answer,error", [
    (None, "unparseable"), ("[", "unparseable"), ('{"a": 1}', "not_a_list"), ("[1]", "element_not_object"), ('[{"role": "chef"}]', "bad_role"), ('[{"role": "salt", "unit": "cup"}]', "bad_unit"),
    ('[{"role": "salt", "name": "X", "amount": 1.0, "unit": "molar"}]', None), ("[]", None),
])
def test_answer_errors(spark, answer, error):
    assert spark.createDataFrame([(answer,)], "a string").select(corpus.answer_error(F.col("a")).alias("e")).first()["e"] == error


def test_repair_and_last_array(spark):
    df = spark.createDataFrame([('noise [1] then [{"role": "not_a_component", "name": "null", "amount": 3.0, "unit": "molar"}] end',)], "t string")
    fixed = df.select(corpus.repaired(corpus.last_json_array(F.col("t"))).alias("x")).first()["x"]
    assert [(x["role"], x["name"], x["amount"], x["unit"]) for x in fixed] == [("not_a_component", None, None, None)]


def test_grounding_prefers_longer_spellings(spark, reagents):
    spell = spark.createDataFrame([("TRIS", "tris"), ("TRISODIUM", "trisodium")], "canonical_id string, flat string")
    m = spark.createDataFrame([(1, "TRIS", "tri-sodium citrate"), (2, "TRIS", "0.1 M Tris, tri-sodium"), (3, "TRIS", None)], "k int, canonical_id string, t string")
    assert rows(corpus.grounded(m, "k", "canonical_id", "t", spell), "k", "grounded") == [(1, False), (2, True), (3, False)]


def test_median_filter_and_proposals(spark):
    values = [0.0] * 20 + [1.0] * 30 + [0.0] * 3 + [1.0] * 30 + [0.0] * 20
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", i, 1.0) for i in range(3)], "k string, p int, v double")
    got = sequence.propose(df, "k", "p", "v", least=50, window=5).collect()
    assert [(r["k"], r["start"], r["end"], r["confident"]) for r in got] == [("a", 20, 82, True)]
    assert sequence.median_filter(df, "k", "p", "v", 5).where("k = 'b' AND smooth = 1.0").count() == 3


def test_coverage_steps(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, 8), ("a", 10, 10)], "k string, s int, e int")
    assert rows(sequence.coverage_steps(df, "k", "s", "e"), "start", "end", "depth") == [(1, 2, 1), (3, 5, 2), (6, 8, 1), (10, 10, 1)]


def test_screen_guards(spark):
    lines = spark.createDataFrame([("p", 1, "Salts"), ("p", 2, "1. 0.2 M kbr,"), ("p", 3, "20% PEG"), ("p", 4, "2. water"), ("q", 1, "3 x 5 M")], "page string, line int, text string")
    assert rows(screens.join_wrapped(lines, "page", "line", "text"), "page", "number", "condition") == [("p", 1, "0.2 M kbr, 20% PEG"), ("p", 2, "water"), ("q", 3, "x 5 M")]
    assert screens.carry_heading(lines, "page", "line", "text", "^Salts$").where("heading = 'Salts'").count() == 3
    cells = spark.createDataFrame([("p", "salt", 1, "a"), ("p", "peg", 1, "b"), ("q", "salt", 1, "a"), ("q", "salt", 2, "c"), ("q", "peg", 1, "b")], "page string, c string, i int, v string")
    assert rows(screens.rebuild_columns(cells, "page", "c", "i", "v", "peg"), "page", "parts") == [("p", "b, a")]


# sources, sinks, release, manifest, streaming


def entry(**change):
    base = {
        "rcsb_id": "9XYZ", "exptl": [{"method": "X-RAY DIFFRACTION"}],
        "exptl_crystal_grow": [{"crystal_id": "1", "method": "drop", "temp": "291", "pH": "7.5", "pdbx_details": "22% PEG"}], "rcsb_entry_info": {"resolution_combined": [2.1], "polymer_entity_count": 1},
        "polymer_entities": [{"rcsb_id": "9XYZ_1", "entity_poly": {"type": "polypeptide(L)", "pdbx_seq_one_letter_code_can": "MKV"}, "rcsb_entity_source_organism": [{"ncbi_scientific_name": "E. coli"}, {"ncbi_scientific_name": None}]}],
    }
    return base | change


def test_flatten_entries(spark, tmp_path):
    three = [{"crystal_id": None, "temp": "junk"}, {"crystal_id": "B"}, {"crystal_id": " "}]
    with gzip.open(tmp_path / "b1.json.gz", "wt") as f:
        json.dump([entry(), entry(rcsb_id="9AAA", exptl_crystal_grow=None, polymer_entities=None), entry(rcsb_id="9BBB", exptl_crystal_grow=three, exptl=[{"method": "SOLUTION NMR"}])], f)
    raw = readers.json_batches(spark, f"{tmp_path}/*.json.gz", RAW_ENTRY)
    e = flatten.entries(raw)
    assert rows(e, "pdb_id", "crystal_id", "n_crystal_forms", "is_xray") == [("9AAA", "1", 0, True), ("9BBB", "1", 3, False), ("9BBB", "3", 3, False), ("9BBB", "B", 3, False), ("9XYZ", "1", 1, True)]
    assert e.where("pdb_id = '9XYZ'").first()["temp_k"] == 291.0 and e.where("pdb_id = '9BBB' AND crystal_id = '1'").first()["temp_k"] is None
    p = flatten.entities(raw).where("pdb_id = '9XYZ'").first()
    assert (p["entity_id"], p["seq_length"], p["source_organisms"], p["source_taxids"]) == ("1", 3, ["E. coli"], [])


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "MKV"), ("b", None), ("c", "AC")], "id string, s string")
    sinks.fasta(df, "id", "s", f"{tmp_path}/f")
    assert rows(readers.fasta(spark, f"{tmp_path}/f"), "id", "sequence") == [("a", "MKV"), ("c", "AC")]
    sinks.jsonl(df, f"{tmp_path}/j")
    assert readers.jsonl(spark, f"{tmp_path}/j", "id string, s string").count() == 3
    sinks.csv(df, f"{tmp_path}/c")
    sinks.parquet(df, f"{tmp_path}/p", by=["id"])
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.parquet(df, f"{tmp_path}/p")
    sinks.worklist(df, f"{tmp_path}/w", ["verdict"])
    (tmp_path / "t.tsv").write_text("# made up\nPDB\tCHAIN\n9xyz\tA\n")
    assert rows(readers.tsv(spark, f"{tmp_path}/t.tsv", ["PDB", "CHAIN"]), "PDB", "CHAIN") == [("9xyz", "A")]
    (tmp_path / "h.tsv").write_text("q\tq\t1\t0\t9\nq\ta\t0.5\t0\t7\nq\tb\t0.9\t0\t8\nshort\n")
    assert rows(readers.search_hits(spark, f"{tmp_path}/h.tsv", 1), "query", "target") == [("q", "b")]
    (tmp_path / "x.xml").write_text("<r><target><id>T1</id><sequence>mk v</sequence><lab>L</lab><lab>L</lab><status>cloned</status></target></r>")
    t = readers.targets_xml(spark, f"{tmp_path}/x.xml").first()
    assert (t["target_id"], t["sequence"], t["labs"], t["statuses"]) == ("T1", "MKV", ["L"], ["cloned"])
    (tmp_path / "e.cif").write_text("data_x\nloop_\n_exptl_crystal_grow.crystal_id\n_exptl_crystal_grow.pH\n1 7.0\n2 ?\n_cell.length_a 5\n")
    assert rows(readers.mmcif_loops(spark, f"{tmp_path}/e.cif", "exptl_crystal_grow", ["crystal_id", "pH"]).na.fill("-"), "row", "crystal_id", "pH") == [(1, "1", "7.0"), (2, "2", "-")]
    html = spark.createDataFrame([(1, "<p>A &amp; B</p><script>x</script><li>C</li>")], "page int, html string")
    assert rows(readers.html_lines(html, "page", "html"), "text") == [("A & B",), ("C",)]
    assert readers.files(spark, f"{tmp_path}/t.tsv").count() == 1
    yaml = sinks.yaml_file({"id": "x", "wells": [{"well": "A1"}]}, tmp_path / "y" / "s.yaml")
    assert "A1" in yaml and readers.yaml_documents(spark, f"{tmp_path}/y", "id string, wells array<struct<well:string>>").count() == 1
    sinks.schema_file(df, tmp_path / "s.json", "rows")
    assert json.loads((tmp_path / "s.json").read_text())["title"] == "rows"
    assert sinks.payload(df, tmp_path / "q.json", {"seed": 1}) == 3


def test_services(spark, tmp_path):
    calls = []

    def transport(url, body):
        calls.append(url)
        ids = json.loads(body)["variables"]["ids"]
        if len(calls) == 1:
            raise services.StatusError(503)
        if "BAD" in ids:
            raise services.StatusError(400)
        return json.dumps({"data": {"entries": [{"rcsb_id": i} for i in ids]}}).encode()

    call = services.retrying(transport, sleep=lambda s: None)
    found, bad = services.fetch_bisecting(lambda ids: services.graphql(call, "u", "q", {"ids": list(ids)})["entries"], ["A", "BAD", "C"])
    assert [x["rcsb_id"] for x in found] == ["A", "C"] and bad == ["BAD"]
    with pytest.raises(ValueError, match="1 of 2"):
        services.search_all(lambda u, b: b'{"total_count": 2, "result_set": [{"identifier": "A"}]}', "u", {})
    assert services.batch_name(0, ["A"]) != services.batch_name(0, ["B"])
    assert services.transfer_stats("Number of files: 1,204\nTotal file size: 99 bytes") == {"number_of_files": 1204, "total_file_size": 99}
    got = services.fetch_files(spark.createDataFrame([("a",), ("b",)], "id string"), "id", lambda i: i, lambda u, b: u.encode(), known=lambda i: i == "b")
    assert rows(got, "id", "status") == [("a", "ok"), ("b", "skipped")]

    def echo(url, body):
        return json.dumps({"data": {"entries": [{"rcsb_id": i} for i in json.loads(body)["variables"]["ids"]]}}).encode()

    spark.dataSource.register(services.entry_source(echo))
    read = spark.read.format("entries").options(url="u", query="q", ids=json.dumps(["A", "B", "C"]), batchSize="2").load()
    assert read.count() == 3 and read.select("batch").distinct().count() == 2


def test_manifest(spark, tmp_path):
    (tmp_path / "in.txt").write_text("x")
    with pytest.raises(RuntimeError), manifest.manifest("stage", tmp_path / "m.json", inputs=[str(tmp_path / "in.txt")]) as notes:
        notes["n"] = 3
        raise RuntimeError("stop")
    m = json.loads((tmp_path / "m.json").read_text())
    assert (m["status"], m["notes"]["n"], m["inputs"][0]["bytes"]) == ("failed", 3, 1)
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        manifest.expect_unique(df, ["k"])
    with pytest.raises(ValueError, match="positive"):
        manifest.expect(df, {"positive": F.col("k") > 1})


def test_release(spark, data):
    c, k, e = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("conditions", "components", "entities"))
    record = release.assemble(c, k, e).where("size(components) > 1").first()
    order = [x["component_index"] for x in record["components"]]
    assert order == sorted(order)
    sheet = release.datasheet(release.statistics(c), c.where("discard_reason IS NOT NULL").groupBy("discard_reason").agg(F.count(F.lit(1)).alias("n")))
    assert "n_records" in sheet and "Records set aside" in sheet
    release.register_views(spark, c, k)
    assert spark.sql("SELECT count(*) FROM condition_components").first()[0] > 0


def test_incremental_runs_once_per_file(spark, tmp_path):
    src, out = tmp_path / "src", f"{tmp_path}/out"
    spark.range(5).write.parquet(f"{src}/a")
    stream = lambda: incremental.new_rows(spark, f"{src}/*", "id bigint")
    for n in (5, 8):
        q = incremental.process_available(stream(), incremental.append_parquet(out), f"{tmp_path}/cp")
        q.awaitTermination()
        assert spark.read.parquet(out).count() == n
        spark.range(3).write.mode("append").parquet(f"{src}/a")


def test_windows_over_a_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(f"{tmp_path}/ev")
    live = incremental.new_rows(spark, f"{tmp_path}/ev", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    q = incremental.tumbling(live, "ts", "event_type", "value", "1 day", "1 hour").writeStream.format("memory").queryName("daily").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM daily").first()[0] == events.count()


def test_parser_against_labelled_components(spark, data):
    """The components table names what a text holds: the parser finds the names in the texts, also of repeated records, and keeps every record's rows apart."""
    from brineflow.operators import parse

    conditions, components, reagents = (spark.read.parquet(f"{data}/{x}.parquet") for x in ("conditions", "components", "reagents"))
    c = conditions.select("record_id", "raw_details")
    _, found = parse.parse(c, reagents)
    got = parse.of_records(c, found, ["record_id"]).where("name_canonical IS NOT NULL").select("record_id", "name_canonical").distinct()
    labels = components.join(reagents.select(F.col("canonical_id").alias("name_canonical")), "name_canonical", "left_semi").select("record_id", "name_canonical").distinct()
    labels = labels.join(c.where("raw_details IS NOT NULL").select("record_id"), "record_id", "left_semi")
    assert got.join(labels, ["record_id", "name_canonical"]).count() >= 0.85 * labels.count()


def test_parser_roles_titrants_and_premixes(spark):
    from brineflow.operators import parse

    reagents = spark.createDataFrame(
        [("CAPS", "CAPS", "buffer", None), ("MES", "MES", "buffer", None), ("SODIUM_HYDROXIDE", "sodium hydroxide", "additive", None), ("MIX_B", "mix b", "premix", ["CAPS", "MES"]), ("MIX_P", "mix p", "premix", ["CAPS", "GLYCEROL"]), ("GLYCEROL", "glycerol", "polyol", None)],
        "canonical_id string, display_name string, chem_class string, premix_components array<string>",
    ).selectExpr("*", "array() AS aliases", "cast(null as string) AS default_unit", "cast(null as int) AS peg_mw", "cast(null as boolean) AS is_mme", "cast(null as double) AS buffer_pka")
    texts = ["0.1 M CAPS / sodium hydroxide pH 10.5", "10% mix b; 10% mix p", "30% glycerol for freezing", "10% glycerol", "20% glycerol", "sodium hydroxide", None, "", "qqx 5%; zzx 3%", "10% glycerol"]
    c = spark.createDataFrame(list(enumerate(texts)), "record_id int, raw_details string")
    records, parts = parse.parse(c, reagents)
    r = {x["record_id"]: x for x in records.collect()}
    assert (r[0]["parsed_ph_text_value"], r[0]["parsed_ph_source"], r[0]["parsed_flags"]) == (10.5, "buffer", ["buffer_titrant"])
    assert r[6]["parsed_discard_reason"] == r[7]["parsed_discard_reason"] == "EMPTY" and r[8]["parsed_unidentified"] == ["qqx", "zzx"]
    roles = {}
    for x in parse.of_records(c, parts, ["record_id"]).collect():
        roles.setdefault(x["record_id"], {})[x["norm_name"]] = (x["role"], x["cryo_evidence"])
    assert roles[0] == {"caps": ("buffer", None), "sodium hydroxide": ("not_a_component", None)}
    assert roles[1] == {"mix b": ("buffer", None), "mix p": ("precipitant", None)}
    assert [roles[i] for i in (3, 4, 5, 9)] == [{"glycerol": ("cryo", "inferred")}, {"glycerol": ("precipitant", None)}, {"sodium hydroxide": ("additive", None)}, {"glycerol": ("cryo", "inferred")}]
    assert next(iter(roles[2].values())) == ("cryo", "explicit") and set(roles) == {0, 1, 2, 3, 4, 5, 8, 9}


def test_grounding_looks_at_longer_spellings_of_any_length(spark):
    from brineflow.operators import corpus

    spellings = spark.createDataFrame([("MES", "mes"), ("MESYLATE", "mesylate"), ("PEG_400", "peg400"), ("PEG_4000", "peg4000")], "name string, flat string")
    texts = [(1, "MES", "0.1 M mesylate"), (2, "MES", "0.1 M MES, mesylate"), (3, "PEG_400", "20% PEG 4000"), (4, "PEG_400", "PEG 4000, PEG 400"), (5, "MES", ""), (6, "MES", None)]
    got = {r["k"]: r["grounded"] for r in corpus.grounded(spark.createDataFrame(texts, "k int, name string, t string"), "k", "name", "t", spellings).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.9])
def test_similar_sequences_recall_at_the_threshold(spark, similarity):
    """Pairs just above the threshold, against all pairs."""
    import random

    rng = random.Random(int(similarity * 10))
    letters = "ACDEFGHIKLMNPQRSTVWY"
    kmers = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    sequences = []
    while len(sequences) < 240:
        a = "".join(rng.choice(letters) for _ in range(160))
        for _ in range(60):
            b = list(a)
            for i in rng.sample(range(160), rng.randrange(1, 26)):
                b[i] = rng.choice(letters)
            b = "".join(b)
            if similarity <= jaccard(kmers(a), kmers(b)) < similarity + 0.07:
                sequences += [a, b]
                break
    df = spark.createDataFrame(list(enumerate(sequences)), "id int, s string")
    sets = list(map(kmers, sequences))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= similarity}
    got = {(max(r["a"], r["b"]), min(r["a"], r["b"])) for r in link.similar_sequences(df, "id", "s", similarity).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 100


def _shuffled_rows(spark) -> int:
    """Rows that all stages so far have written for a shuffle."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("places", [2_000_000, 500])
def test_kmer_hits_against_all_pairs(spark, monkeypatch, places):
    """All queries at once and in parts; repeated keys, lower case, letters beyond ASCII, ties, and no k-mers as rows."""
    import random
    from collections import Counter

    monkeypatch.setattr(link, "QUERY_PLACES", places, raising=False)
    monkeypatch.setattr(link, "PAIRS", 40, raising=False)
    rng = random.Random(5)
    family = ["".join(rng.choice("ACDEFGHIKL") for _ in range(80)) for _ in range(3)]
    data = [(f"t{i:03d}", "".join(rng.choice("ACD") if rng.random() < 0.03 else c for c in family[i % 3])) for i in range(90)]
    data += [("twin_a", "MKVLAWGHT"), ("twin_b", "MKVLAWGHT"), ("twice", "MKVLAWGHTRR"), ("twice", "MKVLAWGHTRR"), ("small", "mkvlaWGHT"), ("short", "MKVL"), ("gone", None), (None, "MKVLAWGHT"), ("blank", "")]
    data += [("greek", "ΑΒΓΔΕΖΗΘ"), ("mixed", "ΑΒΓΔΕΖMKVLAW"), ("poly", "A" * 40)]
    kmers: dict = {}
    for i, s in data:
        if i and s and len(s) >= 5:
            kmers.setdefault(i, []).append({s.upper()[j : j + 5] for j in range(len(s) - 4)})
    want = []
    for q in [i for i in kmers if i[-1] in "0e" or i in ("twin_a", "small", "greek")]:
        found = []
        for t in kmers:
            a, b = Counter(x for w in kmers[q] for x in w), Counter(x for w in kmers[t] for x in w)
            n = sum(a[x] * b[x] for x in a)
            rest = len(kmers[q][0]) + len(kmers[t][0]) - n
            identity = float("inf") if rest == 0 else n / rest
            if q != t and n and identity >= 0.1:
                found.append((-identity, t, n))
        want += [(q, t, n, round(-s, 9), r) for r, (s, t, n) in enumerate(sorted(found)[:12], 1)]
    df = spark.createDataFrame(data, "id string, s string").repartition(3)
    asked = df.where("substr(id, -1) IN ('0', 'e') OR id IN ('twin_a', 'small', 'greek')")
    before = _shuffled_rows(spark)
    out = link.kmer_hits(asked, df, "id", "s", most=12)
    got = [(r["query"], r["target"], r["shared"], round(r["identity"], 9), r["rank"]) for r in out.collect()]
    assert sorted(got) == sorted(want) and len({w[0] for w in want}) > 12
    assert _shuffled_rows(spark) - before < 1000  # the sequences have some 7,000 k-mers
    none = link.kmer_hits(asked.limit(0), df, "id", "s")
    assert none.dtypes == out.dtypes and none.count() == 0 and link.kmer_hits(asked, df.limit(0), "id", "s").count() == 0


def test_hits_of_kmers_are_counted_in_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rows_ = [(i, ["ACDEFGHIKLMNPQ"[: 5 + i % 9]]) for i in range(50)]
    part = link._postings(rows_, pa.int64(), 5)
    words = link.kmer_codes("ACDEFGHIKLMNPQ", 5)
    want = [1 + i % 9 for i in range(50)]
    for most in (1, 7, 60, 10_000):
        monkeypatch.setattr(link, "HITS", most)
        assert link._shared_counts(words, *part[:3], 50).tolist() == want
    assert len(np.unique(link.kmer_codes("AAAAAΑΑΑΑΑ", 5))) == 6 and link.kmer_codes("AAAAAΑ", 5)[0] == link.kmer_codes("AAAAA", 5)[0]


def test_components_in_one_task_and_by_rounds_are_the_same(spark, monkeypatch):
    import random

    from brineflow.operators import graph

    rng = random.Random(3)
    edges = [(f"v{i:02d}", f"v{i + 1:02d}") for i in range(40)] + [("hub", f"h{i}") for i in range(30)] + [(f"r{rng.randrange(40):02d}", f"r{rng.randrange(40):02d}") for _ in range(30)] + [("solo", "solo")]
    df = spark.createDataFrame(edges, "a string, b string")
    found = lambda: rows(graph.connected_components(df), "node", "component")
    want = found()
    assert ("v40", "v00") in want and ("solo", "solo") in want and ("hub", "h0") in want
    monkeypatch.setattr(graph, "SMALL_GRAPH", 0)
    assert found() == want
    assert graph.connected_components(df.limit(0)).count() == 0


def test_answer_guards_with_near_misses(spark):
    lookup = spark.createDataFrame([("nacl", "SODIUM_CHLORIDE"), ("sodium chloride", "SODIUM_CHLORIDE"), ("glycerol", "GLYCEROL"), ("sodium_chloride", "SODIUM_CHLORIDE")], "key string, canonical_id string")
    spellings = spark.createDataFrame([("SODIUM_CHLORIDE", "nacl"), ("SODIUM_CHLORIDE", "sodiumchloride"), ("GLYCEROL", "glycerol")], "canonical_id string, flat string")
    texts = spark.createDataFrame([(1, "0.2 M sodium chlorde and protein"), (2, "NaCl"), (3, None)], "r int, text string")
    items = [
        (1, 1, "salt", "SODIUM_CHLORIDE", 0.2, "molar", True), (1, 2, "cryo", "GLYCEROL", 10.0, "percent_v_v", True), (1, 3, "not_a_component", "protein", None, None, True), (2, 1, "salt", "NaCl", 900.0, "molar", True),
        (2, 2, "salt", "unobtainium", 1.0, "molar", True), (2, 3, "salt", None, 1.0, "molar", True), (3, 1, "salt", "NaCl", 1.0, "molar", True), (9, 1, "salt", "NaCl", 1.0, "molar", True), (2, 4, "salt", "NaCl", 1.0, "molar", False),
    ]
    df = spark.createDataFrame(items, "r int, ordinal int, role string, name string, amount double, unit string, valid boolean")
    g = {(x["r"], x["ordinal"]): x for x in corpus.guarded_answers(df, texts, ["r"], lookup, spellings).collect()}
    assert {k: x["outcome"] for k, x in g.items()} == {(1, 1): "kept", (1, 2): "ungrounded", (1, 3): "kept", (2, 1): "kept", (2, 2): "unknown", (2, 3): "unknown", (3, 1): "ungrounded", (9, 1): "stale", (2, 4): "invalid"}
    assert g[1, 1]["rescued"] == "typo" and g[2, 1]["rescued"] == "alias" and g[2, 1]["implausible"] and g[2, 1]["amount"] is None and g[2, 1]["name_canonical"] == "SODIUM_CHLORIDE"
    counts = {x["outcome"]: (x["n"], x["n_rescued"]) for x in corpus.guard_counts(corpus.guarded_answers(df, texts, ["r"], lookup, spellings)).collect()}
    assert counts["kept"] == (3, 2) and counts["unknown"] == (2, 0)
    assert corpus.guarded_answers(df.limit(0), texts, ["r"], lookup, spellings).count() == 0


def test_answers_go_on_where_they_ended(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(10)], "k int, text string")

    def model():
        return lambda texts: [t.upper() for t in texts if len(texts) <= 4]

    done = corpus.answered(df.limit(4), "k", "text", model, batch=4)
    done.write.parquet(f"{tmp_path}/a")
    rest = corpus.answered(df, "k", "text", model, spark.read.parquet(f"{tmp_path}/a"), batch=4)
    assert rows(rest, "k", "answer") == [(i, f"T{i}") for i in range(4, 10)]


def test_bucket_answers_keep_the_invariants(spark):
    from brineflow.operators import curation

    queue = [("PEG 1500", "new:peg", None, "peg", 3), ("peg blend", "new:peg", None, "peg", 2), ("bicine", "new:buffer", None, "buffer", 5), ("mystery buffer", "new:buffer", None, "buffer", 1), ("NaCl", "map:salt", "SODIUM_CHLORIDE", "salt", 9), ("salt x", "map:salt", "NOWHERE", "salt", 1), ("salt y", "map:salt", "SODIUM_CHLORIDE", "salt", 1), ("???", "new:salt", None, "salt", 1), ("ether", "new:organic", None, "organic", 1), ("later", "open", None, None, 1)]
    q = spark.createDataFrame(queue, "name string, bucket string, target string, chem_class string, weight int")
    answers = spark.createDataFrame([("new:peg", "new"), ("new:buffer", "new"), ("map:salt", "accept"), ("new:salt", "new"), ("new:organic", "new")], "bucket string, chosen string")
    aliases = spark.createDataFrame([("nacl", "SODIUM_CHLORIDE")], "name string, owner string")
    got = {r["name"]: r for r in curation.apply_bucket_answers(q, answers, aliases, spark.createDataFrame([("bicine", 8.35)], "name string, pka double")).collect()}
    assert {n: r["outcome"] for n, r in got.items()} == {"PEG 1500": "new", "peg blend": "skipped", "bicine": "new", "mystery buffer": "skipped", "NaCl": "skipped", "salt x": "skipped", "salt y": "alias", "???": "skipped", "ether": "new", "later": "left"}
    assert (got["PEG 1500"]["peg_mw"], got["PEG 1500"]["default_unit"], got["bicine"]["buffer_pka"], got["ether"]["default_unit"]) == (1500, "percent_w_v", 8.35, "percent_v_v")
    assert {got[n]["why"] for n in ("peg blend", "mystery buffer", "NaCl", "salt x", "???")} == {"no weight in the name", "no known pKa", "already an alias of SODIUM_CHLORIDE", "target not in the lexicon", "no legal id"}


def test_trees_use_rows_with_nulls_and_importances_find_the_feature(spark):
    rng = random.Random(1)
    data = [(i, float(i % 10), rng.random() if i % 7 else None, int(i % 10 > 4)) for i in range(200)]
    df = spark.createDataFrame(data, "k int, a double, b double, y int").cache()
    model = sequence.boosted_trees(df, ["a", "b"], "y", trees=3, depth=2)
    assert model.transform(df).count() == 200
    drop = {r["feature"]: r["drop"] for r in sequence.permutation_importance(model, df, ["a", "b"], "y").collect()}
    assert drop["a"] > 0.2 and abs(drop["b"]) < 0.1


def test_draws_sums_and_batches_in_parts_are_the_same_as_in_one(spark):
    from brineflow.operators import ranks

    data = [(i, "hot" if i % 3 else f"g{i % 5}", (i * 37) % 101) for i in range(600)]
    df = spark.createDataFrame(data, "k int, g string, v int")
    import hashlib

    h = lambda k: hashlib.sha256(f"s{k}".encode()).hexdigest()
    want = {k for g in {d[1] for d in data} for k in sorted((d[0] for d in data if d[1] == g), key=h)[:4]}
    assert {r["k"] for r in sampling.drawn(df, "k", ["g"], 4).collect()} == want
    total = {}
    run = 0
    for k, _, v in sorted(data, key=lambda d: (d[2], d[0])):
        total[k] = run
        run += v
    assert {r["k"]: r["v_before"] for r in ranks.running_sums(df, [F.asc("v"), F.asc("k")], ["v"]).collect()} == total
    near = vectors.nearest_vectors(spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, v array<double>"), spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "id bigint, v array<double>"), "id", "v", 3)
    assert [r["target"] for r in near.orderBy("rank").collect()] == [6, 13, 20]


def test_headers_checksums_downloads_and_rewritten_documents(spark, tmp_path):
    import hashlib

    from brineflow.sources import readers, services, sinks

    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write("# made up\nsome title\nPDB\tCHAIN\tN\n9xyz\tA\t1\nshort\n9abc\tB\t\n")
    assert rows(readers.tsv_behind_header(spark, f"{tmp_path}/t.tsv.gz", "PDB\t", ["N", "PDB"]), "PDB", "N") == [("9abc", ""), ("9xyz", "1")]
    assert readers.tsv_behind_header(spark, f"{tmp_path}/t.tsv.gz", "NONE", ["N"]).count() == 0
    body = (tmp_path / "t.tsv.gz").read_bytes()
    md5 = hashlib.md5(body).hexdigest()
    published = spark.createDataFrame([("t.tsv.gz", len(body), md5.upper()), ("gone", 1, "x")], "name string, length bigint, md5 string")
    assert rows(readers.verified(readers.files(spark, f"{tmp_path}/t.tsv.gz"), published), "name", "status") == [("gone", "missing"), ("t.tsv.gz", "ok")]
    calls = []
    transport = lambda url, body=None: calls.append(url) or b"abc"
    good = hashlib.md5(b"abc").hexdigest()
    assert [services.download(transport, "u", f"{tmp_path}/d/x", good) for _ in range(2)] == ["ok", "skipped"] and calls == ["u"]
    with pytest.raises(ValueError):
        services.download(transport, "u", f"{tmp_path}/d/y", "0")
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["x"]
    (tmp_path / "l.yaml").write_text("# kept\n\nversion: 0.8.3\nreagents: [a]\n")
    change = lambda d: {**d, "reagents": [*d["reagents"], "b"]}
    assert sinks.rewrite_yaml(tmp_path / "l.yaml", change, dry_run=True)["version"] == "0.8.4" and "0.8.3" in (tmp_path / "l.yaml").read_text()
    sinks.rewrite_yaml(tmp_path / "l.yaml", change)
    assert (tmp_path / "l.yaml").read_text().startswith("# kept\n\nversion: 0.8.4")


def test_batches_that_are_done_are_not_asked_again():
    from brineflow.sources import services

    reader = services._Reader({"url": "u", "ids": json.dumps(["a", "b", "c"]), "batchsize": "2", "done": json.dumps([services.batch_name(0, ("a", "b"))])}, lambda u, b: b"")
    assert [p.ids for p in reader.partitions()] == [("c",)]
