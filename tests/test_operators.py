import random
from collections import Counter
from difflib import SequenceMatcher

import pyspark.sql.functions as F

from mercanta.operators import matching, ml, relational, warehouse
from mercanta.runtime import table
from mercanta.streaming import ingest


def test_surrogate_keys_and_streaks(spark):
    df = spark.createDataFrame([(str(i),) for i in random.Random(1).sample(range(1000, 2000), 300)], "x string").repartition(7)
    out = relational.surrogate_keys(df, ["x"], "sk").orderBy("x").collect()
    assert [r.sk for r in out] == list(range(1, 301))
    runs = spark.createDataFrame([("a", 5, "failed"), ("a", 4, "running"), ("a", 3, "failed"), ("a", 2, "success"), ("a", 1, "failed"), ("b", 1, "failed")], "s string, at int, status string")
    got = relational.bad_streak(runs, ["s"], [F.desc("at")], F.col("status") == "failed", F.col("status") != "running", limit=2).collect()
    assert {(r.s, r.streak, r.disable) for r in got} == {("a", 2, True), ("b", 1, False)}


def test_ranking_metrics(spark):
    df = spark.createDataFrame([("1", 1, 0.9), ("2", 0, 0.1), ("3", 1, 0.8), ("4", 0, 0.2)], "id string, y int, s double")
    row = relational.precision_recall_at(df, "s", "y", "id").first()
    assert (row.precision_at_10, row.recall_at_50) == (0.5, 1.0)
    assert relational.average_precision(df, "s", "y").first().average_precision == 1.0


def test_matches_against_brute_force(spark):
    rnd = random.Random(3)
    words = ["mouse", "teclado", "gamer", "usb", "m170", "x200", "preto", "branco", "logitech", "sem", "fio", "k95", "rgb", "optico"]
    rows = lambda p, n: [(f"{p}{i}", " ".join(rnd.sample(words, rnd.randrange(2, 7))), rnd.choice([5.0, 50.0, 200.0])) for i in range(n)]
    left, right = rows("p", 25), rows("e", 40)
    make = lambda r: matching.described(spark.createDataFrame(r, "id string, t string, price double"), "id", "t", "price")
    products, evidence = make(left), make(right)
    got = {(r.p_key, r.e_key): r.score for r in matching.matches(products, evidence).collect()}
    pairs = products.alias("p").crossJoin(evidence.alias("e")).select(F.struct("p.*").alias("p"), F.struct("e.*").alias("e"), matching.text_ratio("p.norm", "e.norm", F.lit(0.0)).alias("ratio"))
    want = {(r.a, r.b): r.s for r in pairs.select(F.col("p.key").alias("a"), F.col("e.key").alias("b"), matching._score("p", "e", F.col("ratio"), matching._is_dear(F.col("p.price"), F.col("e.price"))).alias("s")).collect() if r.s >= matching.LEAST_SCORE}
    assert got == want and got
    details = matching.match_details(matching.matches(products, evidence), most=2).collect()
    assert {r.p_key for r in details} == {p for p, _ in got} and all(1 <= r.details.count("e_key") <= 2 for r in details)
    one = spark.createDataFrame([("abc def", "abd def")], "a string, b string").select(matching.text_ratio("a", "b", F.lit(0.0)).alias("r")).first().r
    assert one == SequenceMatcher(None, "abc def", "abd def").ratio()
    assert matching.matches(products.limit(0), evidence).count() == 0


def test_candidates_cut_rows_of_titles(spark):
    """The cut counts rows: of a title that straddles it, the first rows by key stay."""
    make = lambda r: matching.described(spark.createDataFrame(r, "id string, t string, price double"), "id", "t", "price")
    products = matching.numbered(make([("p", "mouse gamer m170 preto", 10.0)]))
    evidence = make([(f"a{i}", "mouse m170", 1.0) for i in range(5)] + [("b", "mouse gamer m170 preto", 1.0), ("c", "preto", 1.0)] + [(f"d{i}", "gamer mouse", 1.0) for i in range(4)])
    titles = evidence.sparkSession.createDataFrame(matching.titles_of(evidence).collect(), matching.titles_of(evidence).schema)
    got = {r.e_key for r in matching.candidates(products, evidence, titles, most=8).collect()}
    assert got == {"b", *(f"a{i}" for i in range(5)), "d0", "d1"}


def test_price_levels(spark):
    df = spark.createDataFrame([("p", 60.0, float(x), i + 1) for i, x in enumerate([10, 20, 30, 40])] + [("p", 50.0, 1000.0, 5)], "p_key string, score double, price double, rank int")
    row = matching.price_levels(df).first()
    assert (row.level, row.prices) == (20.5, 4)


def test_star_schema_has_unknown_members(spark, data):
    fact = warehouse.opportunity_fact(spark, data)
    assert fact.count() == table(spark, data, "decision_opportunity_snapshots").count()
    odd = spark.createDataFrame([("x",), (None,), ("revisar",)], "r string")
    d = warehouse.recommendation_dimension(spark)
    assert sorted(r.sk for r in relational.with_unknown(odd, d, "r", "code", "sk").collect()) == [2, 99, 99]


def _examples(spark, n=160):
    rnd = random.Random(5)
    rows = [(f"i{k}", *(rnd.random() * 100 for _ in ml.FEATURES), 0, float(k % 5 == 0), 1.0) for k in range(n)]
    df = spark.createDataFrame(rows, ", ".join(["id string", *(f"{f} double" for f in ml.FEATURES), "class int", "label double", "weight double"]))
    return df.withColumn("match_confidence", F.col("match_confidence") + 200 * F.col("label")).withColumn("total_fee_pct", F.lit(0.32))


def test_out_of_fold_covers_every_row_once(spark):
    rows = ml.with_folds(_examples(spark), 3)
    scored = ml.out_of_fold(rows, ml.candidates()["logistic_regression"], 3, synthetic=2)
    assert scored.count() == scored.select("id").distinct().count() == rows.count()
    m = ml.metrics(scored)
    assert m["average_precision"] > 0.95 and m["roc_auc"] > 0.95 and m["tp"] + m["fp"] + m["fn"] + m["tn"] == 160


def test_synthetic_rows_are_bounded(spark):
    positives = _examples(spark).where("label = 1")
    s = ml.synthetic_positives(positives, 3)
    assert s.count() == 3 * positives.count()
    assert s.where("demand_score > 100 OR match_confidence > 100 OR supplier_price < 0 OR weight != 0.30").count() == 0
    assert s.where("abs(estimated_net_profit - (estimated_market_price * 0.68 - supplier_price)) > 1e-9").count() == 0


def test_selection_and_counts(spark, data):
    m = {"a": {"average_precision": 0.9, "f1": 0.8}, "a+synthetic": {"average_precision": 0.9005, "f1": 0.9}, "b": {"average_precision": 0.89, "f1": 1.0}}
    assert ml.select_model(m) == "a" and ml.select_model(m, synthetic_gain=0.0001) == "a+synthetic" and ml.select_model(m, forced="b") == "b"
    assert ml.positive_weight(1, 3) == 3.0 and ml.effective_folds(2, 3, 5) == 2
    features = ml.feature_rows(table(spark, data, "decision_opportunity_snapshots"))
    assert "decision_score" not in features.columns and len(ml.FEATURES) == 16
    assert features.where("label NOT IN (0, 1)").count() == 0


def test_importance_finds_the_telling_feature(spark):
    from pyspark.ml import Pipeline

    rows = _examples(spark)
    model = Pipeline(stages=ml.candidates()["logistic_regression"]).fit(rows)
    lost = ml.permuted_importance(model, rows, ["match_confidence", "supplier_price"], repeats=2)
    assert lost["match_confidence"][0] > 0.2 > abs(lost["supplier_price"][0])
    own = ml.own_importance(model)
    assert max(own, key=own.get) == "match_confidence"


def test_folds_and_holdout_are_stratified(spark):
    rows = _examples(spark)
    counts = {(r.fold, r.label): r["count"] for r in ml.with_folds(rows, 4).groupBy("fold", "label").count().collect()}
    assert set(counts.values()) == {8, 32} and len(counts) == 8
    held = {(r.held, r.label): r["count"] for r in ml.with_holdout(rows, 0.25).groupBy("held", "label").count().collect()}
    assert held == {(True, 1.0): 8, (False, 1.0): 24, (True, 0.0): 32, (False, 0.0): 96}
    try:
        ml.training_rows(rows.where("label = 0"))
        raise AssertionError("no positives")
    except ValueError:
        pass


def test_kept_models_score_alike(spark, tmp_path):
    from pyspark.ml import Pipeline

    rows = _examples(spark)
    stages = ml.candidates(trees=5, rounds=(2, 3))
    assert list(stages) == ["logistic_regression", "random_forest", "boosted_trees", "boosted_trees_long"]
    model = Pipeline(stages=stages["random_forest"]).fit(rows)
    ml.save_model(model, str(tmp_path / "m"))
    kept = {r.id: r.predicted for r in ml.scored_by(str(tmp_path / "m"), rows).collect()}
    assert kept == {r.id: int(r.prediction) for r in model.transform(rows).collect()}
    measured = ml.measured_candidates(ml.with_folds(rows, 2), {"logistic_regression": stages["logistic_regression"]}, 2, synthetic=1)
    assert set(measured) == {"logistic_regression", "logistic_regression+synthetic"} and ml.select_model(measured) in measured
    assert ml.model_run(spark, "1", "m", "p", measured["logistic_regression"]).count() == 1
    assert "match_confidence" in ml.model_card("m", measured["logistic_regression"], ml.own_importance(model))


def test_stream_appends_once(spark, data, tmp_path):
    source = table(spark, data, "market_web_listings_raw").select("id", "source_name", "query", "payload_hash", "fetched_date", "fetched_at", "created_at", "blocked")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    key = ["source_name", "query", "payload_hash", "fetched_date"]
    for checkpoint in ("c1", "c2"):  # the second replays every file
        ingest.append_new(ingest.listing_stream(spark, str(tmp_path / "in"), source.schema, 1), str(tmp_path / "out"), key, ["created_at", "id"], str(tmp_path / checkpoint)).awaitTermination()
    keyed = source.where("query IS NOT NULL").select(*key).distinct().count()
    assert spark.read.parquet(str(tmp_path / "out")).where("query IS NOT NULL").count() == keyed
    counts = ingest.windowed_counts(ingest.listing_stream(spark, str(tmp_path / "in"), source.schema), "fetched_at", "source_name")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("cycles").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n_rows) AS n FROM cycles").first().n == source.count()
    once = ingest.deduplicated(ingest.listing_stream(spark, str(tmp_path / "in"), source.schema), "fetched_at", ["id"]).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.sql("SELECT count(DISTINCT id) = count(*) AS ok FROM once").first().ok


def test_ratio_is_that_of_difflib():
    rnd = random.Random(5)
    texts = ["", "a", "abcabc", "x" * 250, "ab" * 120] + ["".join(rnd.choice("abc 1") for _ in range(rnd.randrange(1, 90))) for _ in range(120)]
    for a in texts[:40]:
        for b in texts:
            assert matching._ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


def _token_sides(spark, n_products, n_titles):
    rnd = random.Random(8)
    common, rare = [f"com{i}" for i in range(9)], [f"rare{i}x" for i in range(200)]
    title = lambda: " ".join(rnd.sample(common, rnd.randrange(0, 6)) + rnd.sample(rare, rnd.randrange(1, 4)))
    left, right = [(f"p{i}", title(), 1.0) for i in range(n_products)], [(f"e{i:04}", title(), 1.0) for i in range(n_titles)]
    left, right = left + [("again", left[0][1], 9.0)], right + [(f"f{i:04}", right[i % 7][1], 2.0) for i in range(90)]
    make = lambda r: matching.described(spark.createDataFrame(r, "id string, t string, price double"), "id", "t", "price")
    return left, right, make(left), make(right)


def test_blocks_give_what_brute_force_gives(spark, monkeypatch):
    """Overlaps, partners and the cut, with several blocks and chunks, common and rare tokens, and products of one title."""
    left, right, products, evidence = _token_sides(spark, 40, 700)
    monkeypatch.setattr(matching, "BLOCK_TITLES", 250)
    monkeypatch.setattr(matching, "CHUNK_PRODUCTS", 15)
    most_common = 330
    n = Counter(t for _, title, _ in right for t in set(title.split()))
    shared = {}
    for p, title, _ in left:
        tokens = title.split()
        for e, other, _ in right:
            both = [i for i, t in enumerate(tokens) if t in other.split() and n[t] <= most_common]
            if both:
                shared.setdefault(p, []).append((-len(both), both[0], e))
    numbered = matching.numbered(products)
    assert numbered.select("p_id").distinct().count() == len({t for _, t, _ in left})
    titles = matching.written(matching.titles_of(evidence), "titles")
    counts = matching.partner_counts(numbered, titles, most_common).join(numbered, "p_id").collect()
    assert {r.key: (r.best_overlap, r.partners) for r in counts} == {p: (-min(x)[0], len(x)) for p, x in shared.items()}
    got = {}
    for r in matching.candidates(numbered, evidence, titles, most=50, most_common=most_common).collect():
        got.setdefault(r.p_key, set()).add(r.e_key)
    assert got == {p: {e for *_, e in sorted(x)[:50]} for p, x in shared.items()}
