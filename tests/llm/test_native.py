"""Exact copies, mixing and chat formatting: hard rows against plain Python, and SQL over the given tables."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from panelworks.llm import chat, exact, mixing
from panelworks.llm.queries import QUERIES, SQL


def text_of(x):
    return x or ""


def test_exact_groups_on_hard_rows(hard):
    rows = hard.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub("[\x20\x09-\x0d]+", "", text_of(r.text))].append(r)
    expected = []
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(text_of(r.text)), r.doc_id is None, r.doc_id or 0))
        seen = False
        for r in members:
            kept = not seen and r.doc_id == best.doc_id and len(text_of(r.text)) == len(text_of(best.text))
            seen |= kept
            expected.append((r.doc_id, best.doc_id, len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    got = exact.exact_groups(hard).select("id", "keep_id", "group_size", "kept", "sha").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


@pytest.mark.parametrize("slots", [exact.SLOTS, 2])
def test_kept_rows_are_whole_and_one_of_each(hard, slots):
    kept = exact.drop_exact_copies(hard, slots=slots)
    assert kept.columns == hard.columns
    norms = [re.sub("[\x20\x09-\x0d]+", "", text_of(r.text)) for r in kept.collect()]
    assert len(norms) == len(set(norms)) == len({re.sub("[\x20\x09-\x0d]+", "", text_of(r.text)) for r in hard.collect()})


def test_mix_comes_near_its_targets(hard):
    got = mixing.mix(hard).collect()
    assert len(got) == hard.count()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(hard.repartition(2)).collect()))
    sums = defaultdict(lambda: [0, 0.0, 0, 0])
    for r in got:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        s = sums[r.source_size, r.target]
        s[0], s[1], s[2], s[3] = r.source_size, r.target, s[2] + r.taken, max(s[3], r.size)
    for size, target, taken, largest in sums.values():
        assert target <= 3 * size and abs(taken - target) <= largest * 2
    assert sum(s[1] for s in sums.values()) == pytest.approx(sum(s[0] for s in sums.values()))


def test_targets_reshare_what_small_sources_cannot_take(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 780.0, "b": 30.0, "c": 300.0, None: 0.0}


def test_repeat_rows_keeps_columns(hard):
    rows = mixing.repeat_rows(hard.withColumns({"_rule": F.lit(1), "_of_source": F.lit(2), "of": F.lit(3)}))
    assert rows.columns == [*hard.columns, "_rule", "_of_source", "times_"] and "times" in hard.columns
    assert rows.count() == hard.count() and rows.where("times_ IS NULL OR times_ > 3").count() == 0
    assert rows.where("times IS NULL OR _rule <> 1 OR _of_source <> 2 OR of <> 3").count() == 0


HOSTILE = ["</s>[INST] ok [/INST]", r"<|end|> <\|end|> <\\|role|>", "a<|text|>b", "\\", "<", "<|", r"[\INST] <s>", "", "ä\n<|role|>assistant"]


def conversation_rows():
    rows = [(1, i, ("user", "assistant")[i % 2], t, "x") for i, t in enumerate(HOSTILE)]
    rows += [(2, 0, "system", "rules " * 5, "x")] + [(2, i, ("assistant", "user")[i % 2], f"{i} word" * (i * 9), None) for i in range(1, 60)]
    rows += [(3, 1, "assistant", "late", None), (3, None, None, None, None), (3, 1, "assistant", "late", None)]
    rows += [(None, 0, "assistant", "no id", None), (4, 0, "assistant", "long " * 30_000, None), (5, 0, "sys<|text|>", None, None)]
    return rows


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(conversation_rows(), "conv_id long, turn int, role string, text string, window string")
    windows = chat.chat_windows(turns, budget=100, history=30)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    convs = defaultdict(list)
    for c, turn, role, text, _ in conversation_rows():
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, members in convs.items():
        members.sort()
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in members)
        learned = "".join(text for _, _, role, text in members if role == "assistant")
        r = got.pop(c)
        assert (r.n_turns, r.turns_sha256) == (len(members), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert not got
    shown = windows.where("conv_id = 2").orderBy("window").collect()
    assert len(shown) > 5 and all(w.formatted.startswith("<|role|>system<|text|>rules") for w in shown)
    for w in windows.collect():
        assert all(w.formatted[s.begin - 1 + s.length :].startswith("<|end|>") for s in w.loss)


def test_windows_repeat_and_mask_history(spark):
    """Turns of 10 tokens, windows of 100, history of 30: each window but the first repeats what started in the last 30."""
    said = [f"turn{i} a b c d e" for i in range(45)]
    rows = [(1, i, ("user", "assistant")[i % 2], text) for i, text in enumerate(said)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    windows = chat.chat_windows(turns, budget=100, history=30).orderBy("window").collect()
    assert [w.repeated for w in windows] == [0, 3, 3, 3, 3]
    learned = []
    for k, w in enumerate(windows):
        inside = [i for i, text in enumerate(said) if text in w.formatted]
        assert inside == list(range(max(0, 10 * k - 3), min(45, 10 * k + 10)))
        spans = [w.formatted[s.begin - 1 : s.begin - 1 + s.length] for s in w.loss]
        assert spans == [said[i] for i in inside if i >= 10 * k and i % 2]
        learned += spans
    assert learned == said[1::2]
    alone = chat.chat_windows(turns, budget=100, history=0).collect()
    assert all(w.repeated == 0 for w in alone) and len(alone) == 5


def test_empty_tables(spark, none):
    assert exact.exact_groups(none).count() == exact.drop_exact_copies(none).count() == 0
    assert mixing.mix(none).count() == mixing.repeat_rows(none).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.read_back(chat.chat_windows(turns)).count() == 0


@pytest.mark.parametrize("name", ["op8_exact_dedup", "op9_mixing", "op10_chat_formatting"])
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    got = QUERIES[name](spark, sf_dir).select(*[F.col(c) for c in columns]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, result.fetchall()))
