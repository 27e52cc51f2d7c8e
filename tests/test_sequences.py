import pytest
from helpers import asked, doc, docs, plan
from pyspark.sql import Observation
from pyspark.sql import functions as F

from schemaloom.config import RetrievalConfig, RunConfig
from schemaloom.functions import prompts as P
from schemaloom.functions import sequences as seq
from schemaloom.functions.links import LINKS_TYPE
from schemaloom.operators import predict
from schemaloom.operators import sequences as S
from schemaloom.plans import jobs


def pairs(spark, rows):
    return spark.createDataFrame(rows, "question_id bigint, prompt_ids array<int>, answer_ids array<int>")


@pytest.mark.parametrize(
    "prompt, answer, prompt_out, answer_out, cut",
    [
        ([1, 2, 3], [7, 8], [1, 2, 3], [7, 8], False),  # exactly at the limit
        ([1, 2, 3, 4], [7, 8], [2, 3, 4], [7, 8], True),  # the end of the prompt stays
        ([], [7], [], [7], False),
        ([1, 2], [7, 8, 9, 10], [2], [7, 8, 9, 10], True),
        ([1, 2], [5, 6, 7, 8, 9], [], [5, 6, 7, 8, 0], True),  # no room for the prompt
        ([1, 2], [4, 5, 6, 7, 8, 9], [], [4, 5, 6, 7, 0], True),
    ],
)
def test_truncate_pair(spark, prompt, answer, prompt_out, answer_out, cut):
    row = S.truncate_pair(pairs(spark, [(1, prompt, answer)]), 5, eos_id=0).first()
    assert (row.prompt_ids, row.answer_ids, row.truncated) == (prompt_out, answer_out, cut)


def test_label_mask_and_report(spark):
    fitted = S.truncate_pair(pairs(spark, [(1, [1, 2], [3]), (2, [1] * 9, [3])]), 5, eos_id=0)
    row = S.label_mask(fitted).where("question_id = 1").first()
    assert (row.input_ids, row.attention_mask, row.labels) == ([1, 2, 3], [1, 1, 1], [-100, -100, 3])
    report = S.truncation_report(fitted).first()
    assert (report.truncated_rows, report.total_rows) == (1, 2)


def test_batches_are_padded_to_their_longest_row(spark):
    rows = [(i, list(range(i % 5)), [9]) for i in range(40)]
    masked = S.label_mask(S.truncate_pair(pairs(spark, rows), 50, eos_id=0))
    batched = S.assign_batches(masked, "question_id", 4, seed=3)
    padded = S.pad_batch(batched, pad_id=77)
    assert padded.count() == 40
    by_batch = {}
    for r in padded.collect():
        by_batch.setdefault(r.batch, []).append(r)
        n = r.question_id % 5 + 1
        assert r.input_ids[n:] == [77] * (len(r.input_ids) - n)
        assert r.attention_mask == [1] * n + [0] * (len(r.input_ids) - n)
        assert r.labels[n - 1 :] == [9] + [-100] * (len(r.input_ids) - n)
    for members in by_batch.values():
        assert len(members) == 4
        assert {len(m.input_ids) for m in members} == {max(m.question_id % 5 + 1 for m in members)}
    again = S.pad_batch(S.assign_batches(masked.repartition(6), "question_id", 4, 3), 77)
    assert sorted(map(str, padded.collect())) == sorted(map(str, again.collect()))


def test_only_the_last_batch_is_short(spark):
    rows = spark.range(1_003).select(F.col("id").alias("question_id"))
    sizes = {r.batch: r["count"] for r in S.assign_batches(rows, "question_id", 8, seed=1).groupBy("batch").count().collect()}
    assert sizes == {b: 8 if b < 125 else 3 for b in range(126)}


def test_input_budget(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(seq.input_budget(F.col("ids"), 2)).collect()] == [[2, 3], []]


def test_arrow_tokenizer_matches_the_column_one(spark):
    def load():
        return lambda texts: [[len(w) for w in t.split()] for t in texts]

    df = spark.createDataFrame([("a bb ccc",), ("",)], "t string")
    assert [r[0] for r in df.select(seq.tokenizer_ids(F.col("t"), load)).collect()] == [[1, 2, 3], []]
    ids = [r[0] for r in df.select(seq.hashed_token_ids(F.col("t"), 100)).collect()]
    assert len(ids[0]) == 3 and ids[1] == [] and all(0 <= i < 100 for i in ids[0])


DB = doc({"Shop": [("ShopID", "number"), "Name"], "Town": ["TownID"]}, pk=["Shop.ShopID"], fk=[("Shop.ShopID", "Town.TownID")])


def candidates(spark, c):
    from schemaloom.operators import retrieval as R

    return R.candidate_schema(asked(spark, [(1, "k", "shop name")]), docs(spark, {"k": DB}), c, 10)


def test_candidate_text(spark):
    df = candidates(spark, RetrievalConfig())
    text = lambda c, fmt: df.select(P.serialize_candidates(F.col("candidates"), c, fmt)).first()[0]
    assert text(RetrievalConfig(), "ids") == (
        "Candidate schema. Use the IDs, not names, in your JSON answer.\n"
        "T1 = Shop\n  C1 = ShopID [number PK FK]\n  C2 = Name [text]\n"
        "T2 = Town\n  C1 = TownID [text FK]"
    )
    plain = RetrievalConfig(include_types=False, include_keys=False)
    assert text(plain, "names").split("\n")[1:] == ["Table: Shop", "  - ShopID", "  - Name", "Table: Town", "  - TownID"]
    keys = RetrievalConfig(include_types=False)
    assert "  C1 = ShopID [PK FK]\n  C2 = Name\n" in text(keys, "ids")
    with pytest.raises(ValueError):
        P.system_prompt("xml")


def test_link_questions_with_a_stub(spark):
    def load():
        return lambda prompts: ['{"T1":["C2"]}' if "shop" in p else "?" for p in prompts]

    rows = asked(spark, [(1, "k", "shop name"), (2, "k", "nothing")])
    df = jobs.link_questions(rows, docs(spark, {"k": DB}), RunConfig(), load, 10)
    assert plan(df).count("ArrowEvalPython") == 1
    got = {r.question_id: [(e.table_name, e.cols) for e in r.parsed] for r in df.collect()}
    assert got == {1: [("Shop", ["Name"])], 2: []}


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return lambda prompts: [p.upper() for p in prompts]

    df = spark.range(1000).select(F.col("id").cast("string").alias("p")).repartition(24, "p")
    assert predict.batch_predict(df, "p", load).where("response = p").count() == 1000
    # Four cores run the 24 tasks in a few workers.
    assert 1 <= len(list(tmp_path.iterdir())) <= 8


def test_payloads_and_sequences(spark):
    rows = asked(spark, [(1, "k", "shop name")]).withColumn(
        "schema_links", F.from_json(F.lit('{"Shop":["Name"]}'), LINKS_TYPE)
    )
    payloads = jobs.example_payloads(rows, docs(spark, {"k": DB}), RetrievalConfig(), columns=10)
    row = payloads.first()
    assert row.assistant == '{"T1":["C2"]}' and row.user.endswith("Question:\nshop name\n\nJSON answer:")
    chat = jobs.chat_rows(payloads).first()
    assert [m.role for m in chat.prompt] == ["system", "user"] and chat.completion[0].content == row.assistant
    made = jobs.training_sequences(payloads, 32).first()
    assert len(made.input_ids) == len(made.labels) == 32 and made.truncated


def test_sft_records(spark):
    rows = asked(spark, [(1, "k", "shop name"), (2, "gone", "x")]).withColumn(
        "schema_links", F.from_json(F.lit('{"Town":[],"Shop":["ShopID","Name"]}'), LINKS_TYPE)
    )
    (row,) = jobs.sft_records(rows, docs(spark, {"k": DB}), columns=10).collect()
    assert row.messages[1].content == (
        "You are given a database schema and a natural language question.\n"
        "Return ONLY valid JSON mapping table names to lists of column names.\n"
        "Include tables even if no specific columns are used.\nDo not include explanations.\n\n"
        "Schema:\nDatabase schema:\nTable: Shop\n  Columns:\n  - Name [text]\n  - ShopID [number] PRIMARY KEY FOREIGN KEY\n"
        "Table: Town\n  Columns:\n  - TownID [text]\n\nQuestion:\nshop name\n\nAnswer:"
    )
    assert row.messages[2].content == '{"Shop": ["Name", "ShopID"], "Town": []}'
    assert (row.num_tables, row.num_columns, row.is_multitable, row.has_empty_columns) == (2, 2, True, True)


def test_sft_records_count_what_they_drop(spark, tmp_path):
    rows = asked(spark, [(1, "k", "shop name"), (2, "gone", "x"), (3, None, "y"), (4, "k", None)]).withColumn(
        "schema_links", F.from_json(F.lit('{"Town":[]}'), LINKS_TYPE)
    )
    catalog = docs(spark, {"k": DB})
    for columns in (10, None):
        seen = Observation()
        records = jobs.sft_records(rows, catalog, columns=columns, observed=seen)
        records.write.mode("overwrite").json(str(tmp_path / "records"))
        assert seen.get == {"rows": 4, "without_schema": 2}
        assert records.drop("messages").collect() == jobs.sft_records(rows, catalog, columns=columns).drop("messages").collect()


def test_cut_sequences_are_counted(spark):
    rows = asked(spark, [(1, "k", "shop name"), (2, "k", "a b c d e f g h " * 90)]).withColumn(
        "schema_links", F.from_json(F.lit('{"Shop":["Name"]}'), LINKS_TYPE)
    )
    payloads = jobs.example_payloads(rows, docs(spark, {"k": DB}), RetrievalConfig(), columns=10)
    seen = Observation()
    made = jobs.training_sequences(payloads, 500, observed=seen).collect()
    assert seen.get == {"rows": 2, "truncated": sum(r.truncated for r in made)} and seen.get["truncated"] == 1


def test_token_batches():
    lengths = [5, 1, 9, 1, 0, 30, 5, 4]
    batches = [list(map(int, b)) for b in predict.token_batches(lengths, 10)]
    assert batches == [[1, 3, 4], [7, 0], [6], [2], [5]]
    assert all(len(b) == 1 or max(lengths[i] for i in b) * len(b) <= 10 for b in batches)
    assert predict.token_batches([], 10) == []
    assert [len(b) for b in predict.token_batches([0] * 25, 10)] == [10, 10, 5]


@pytest.mark.parametrize("budget", [1, 7, 40, 10**9])
def test_responses_do_not_depend_on_the_budget(spark, tmp_path, budget):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        def model(prompts):
            longest = max(len((p or "").split()) for p in prompts)
            open(os.path.join(folder, f"{len(prompts)}-{longest}-{uuid.uuid4().hex}"), "w").close()
            return [None if p is None else p.upper() for p in prompts]

        return model

    words = F.array_join(F.transform(F.sequence(F.lit(1), F.col("id") % 23), lambda i: F.lit("w")), " ")
    text = F.when(F.col("id") == 5, None).when(F.col("id") == 6, "").otherwise(words)
    df = spark.range(300).select("id", text.alias("p"))
    got = predict.batch_predict(df, "p", load, budget)
    assert got.where("response is distinct from upper(p)").count() == 0
    for number, longest, _ in (f.name.split("-", 2) for f in tmp_path.iterdir()):
        assert int(number) == 1 or int(number) * max(int(longest), 1) <= budget


def test_an_incomplete_example_stops_the_selection(spark):
    kind = f"question_id bigint, db_id string, question string, gold_sql string, schema_links {LINKS_TYPE}"
    rows = [(i, "d", "q", "select 1", {"A": [], "B": []} if i else {"A": ["x"]}) for i in range(4)]
    seen = Observation()
    picked = jobs.augmentation_candidates(spark.createDataFrame(rows, kind), 0, 2, ["question_id"], seen)
    assert len(picked.collect()) == 2
    with pytest.raises(Exception, match='example with missing fields: .*"question_id":9'):
        bad = spark.createDataFrame([*rows, (9, "d", None, "s", {})], kind)
        jobs.augmentation_candidates(bad, 0, 2, ["question_id"]).collect()


def test_only_kept_tokens_are_hashed(spark):
    """The rows are those of hashing whole prompts; the prompt is cut before its tokens become ids."""
    given = [(1, "s", "one two three four five six", "a b"), (2, "", "", ""), (3, "s", None, "a"), (4, "s", "x", "long " * 40)]
    payloads = spark.createDataFrame(given, "question_id bigint, system string, user string, assistant string")
    whole = lambda text: seq.hashed_token_ids(text)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for length in (6, 12, 500):
        fitted = jobs.training_sequences(payloads, length)
        assert rows(fitted) == rows(jobs.training_sequences(payloads, length, tokens=whole))
    logical = fitted._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(slice(prompt_ids" in logical
