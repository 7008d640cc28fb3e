import io
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm import chat, rules, tokenstore
from skarn.llm.queries import tokenizer_path
from skarn.llm.textbatch import Texts, pieces

TEXT = st.text(st.characters(codec="utf-8"), max_size=40) | st.lists(st.sampled_from(["a", "B,", " ", "\n", "a b c ", "#é", "\t", "<|", "é"]), max_size=30).map("".join)


def plain_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6))
def test_rule_counts(texts):
    got = rules.count_rules(Texts.of(pa.array(texts, pa.string())))
    assert [[int(got[c][i]) for c in rules.BASE] for i in range(len(texts))] == [plain_rules(t or "") for t in texts]


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 100, "", "c"]})
    assert [p.num_rows for p in pieces(batch, "t", 20)] == [2, 1, 2]


def test_forest_finds_the_odd():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (990, 3)), rng.normal(9, 1, (10, 3))]).astype(np.float32)
    scores = rules.grow_forest(x).scores(x)
    assert np.median(scores[990:]) > np.quantile(scores[:990], 0.99)
    cut = rules.calibrate(scores, np.arange(1000) < 990)
    assert (scores[:990] >= cut).mean() <= 0.005 < (scores[990:] >= cut).mean()
    assert rules.calibrate(scores, np.ones(1000, bool)) > 1


def test_forest_against_walks_of_each_tree():
    """Path lengths by walking down every tree, row by row; trees of a large table get rows of their own."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 3)).astype(np.float32)
    forest = rules.grow_forest(x, trees=20, subsample=32)
    for row, score in zip(x[::70], forest.scores(x[::70]), strict=True):
        total = 0.0
        for feature, cut, length in zip(forest.feature, forest.cut, forest.length, strict=True):
            k = 0
            while feature[k] >= 0:
                k = 2 * k + 1 + (row[feature[k]] >= cut[k])
            total += length[k]
        c = 2 * (np.log(31) + np.euler_gamma) - 2 * 31 / 32
        assert score == pytest.approx(2 ** (-total / 20 / c))


def test_quality_rules_against_brute_force(spark):
    """kept is the base rules and the forest's score under the cut, for every row; the cut loses at most 0.5 % of the good."""
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(600):
        bad = i % 10 == 0
        words = [f"{'W' if bad else 'w'}ord{j}{'!!##' if bad and j % 2 else ''}" for j in rng.integers(0, 900, 30 if i % 50 == 7 else 90)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rules.quality_rules(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    for r in got:
        base = plain_rules(rows[r.doc_id][1])
        assert [r[c] for c in rules.BASE] == base and r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
    judged = [r for r in got if not r.base_failed]
    cut = max(r.anomaly for r in judged if r.kept)
    assert all(r.kept == (r.anomaly <= cut) for r in judged) and not any(r.kept for r in got if r.base_failed)
    assert sum(r.kept for r in judged if r.doc_id % 10 == 0) == 0 and sum(not r.kept for r in judged if r.doc_id % 10) <= 3


def test_quality_rules_defined_cases(spark):
    good = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(1, good, "x"), (None, good, "x"), (1, good, "x"), (2, None, "x"), (3, "", "x"), (4, "a b c " * 50, "x")], "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = rules.quality_rules(df, labels).collect()
    assert sorted(r.kept for r in got) == [False] * 3 + [True] * 3
    assert rules.keep_good(df, labels).collect() == df.where("text like 'word%'").collect()
    assert rules.quality_rules(df.limit(0), labels.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb\\", "<|im_end|>"]) | TEXT, TEXT | st.sampled_from(["<|im_end|>\n<|im_start|>assistant\n", "<\\|", "<\\\\|im_start|>", "<", "|"])), max_size=5))
def test_chat_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True)] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "other": 1}, {"prompt": "q", "completion": "a"}, {"prompt": {"text": "q"}, "completion": {"text": "a"}},
        {"instruction": "q", "input": "", "output": "a"}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"question": "q", "answer": "a"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "no json"), (92, "[1]"), (93, '{"x": 1}')], "id long, record string")
    got = {r.id: r for r in chat.format_records(df).collect()}
    assert all(chat.parse(got[i].formatted) == [("user", "q"), ("assistant", "a")] for i in range(len(records)))
    assert got[90].layout is None and got[90].formatted == ""
    assert all(got[i].layout == chat.OTHER and chat.parse(got[i].formatted) == [("user", r)] and got[i].loss_spans == [] for i, r in ((91, "no json"), (92, "[1]"), (93, '{"x": 1}')))
    assert {(r.layout, r.n) for r in chat.layout_counts(chat.format_records(df)).collect()} >= {(None, 1), (chat.OTHER, 3), ("messages", 1)}


QA, PARTS = [("user", "q"), ("assistant", "a")], [{"type": "text", "text": "q"}, {"type": "text", "text": "more"}]


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "output": "x"}, "messages", QA),
        ({"prompt": "q", "response": "a", "input": "x"}, "prompt and response", QA),
        ({"question": "q", "answer": "a", "system": "s"}, "system, question and answer", [("system", "s"), *QA]),
        ({"messages": [{"role": "user", "content": PARTS}, {"role": "assistant", "content": []}]}, "messages of parts", [("user", "q\nmore"), ("assistant", "")]),
        ({"messages": []}, "messages", []),
        ({"prompt": "q", "completion": "a", "response": "b"}, "prompt and completion", QA),
        ({"instruction": None, "output": 3}, "instruction and output", [("user", ""), ("assistant", "3")]),
    ],
)
def test_fields_of_other_layouts_hide_none(record, layout, turns):
    found = chat.layout_of(record)
    assert found.name == layout and chat.turns_of(record, found) == turns


def test_clashing_columns_of_turn_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "q", "s", "p")], "conv_id long, turn long, role string, text string, system string, prompt string")
    assert chat.parse(chat.format_turn_rows(df).first().formatted) == [("user", "q")]


def test_turn_rows(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (None, None, None, "x", 0), (1, 1, "assistant", "a", 0)], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_turn_rows(df).collect()}
    assert got == {1: [("user", ""), ("assistant", "a"), ("assistant", "b")], None: [("", "x")]}
    assert chat.digest(chat.format_turn_rows(df.limit(0))).collect() == []
    with pytest.raises(ValueError, match="no layout"):
        chat.format_turn_rows(df.drop("role"))


@pytest.fixture(scope="module")
def encoder():
    return tokenstore.Encoder(tokenizer_path())


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXT | st.sampled_from(["Don't, 'S it's.", "<|endoftext|>A.", "Á,. İK.", "x—, y...\x1cz"]), max_size=4))
def test_encoder_is_the_tokenizer(encoder, texts):
    plain = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for end in (None, 2):
        ids, ends = encoder.encode([t.encode() for t in texts], end)
        got = [x.tolist() for x in np.split(ids, ends[:-1])] if texts else []
        assert got == [x if end is None else [*x, end] for x in plain]


def test_encoder_forgets_what_it_used_least():
    small, rng = tokenstore.Encoder(tokenizer_path(), most_kept=50), np.random.default_rng(5)
    for _ in range(20):
        texts = [" ".join(f"{chr(97 + a)}{b} w{chr(97 + a)}," for a, b in rng.integers(0, 26, (8, 2))) for _ in range(4)]
        ids, ends = small.encode([t.encode() for t in texts], 7)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*small.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]
        assert np.all(np.diff(small.keys.astype(object)) > 0)


def test_frames():
    rng = np.random.default_rng(1)
    docs = [(None, np.zeros(0, np.uint32)), *((i // 2, rng.integers(0, 50000, n).astype(np.uint32)) for i, n in enumerate([3, 0, 500, 20, 7, 90]))]
    file = io.BytesIO()
    writer = tokenstore.FrameWriter(file, 100)
    for d in docs:
        writer.add(*d)
    writer.close()
    data = file.getvalue()
    reader = tokenstore.FrameReader(io.BytesIO(data), len(data))
    read = [(k, x.tolist()) for f in range(len(reader.index)) for k, x in zip(*reader.frame(f), strict=True)]
    assert read == [(k, x.tolist()) for k, x in docs]
    assert [x.tolist() for x in reader.documents(1)] == [x.tolist() for k, x in docs if k == 1]
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read(4) == (3).to_bytes(4, "little")
    spoilt = bytearray(data)
    table = len(data) - 9 - 12 * len(reader.table)
    spoilt[table + 12 + 8] ^= 1  # the second frame's checksum
    with pytest.raises(tokenstore.Corrupt):
        tokenstore.FrameReader(io.BytesIO(bytes(spoilt)), len(data)).frame(1)


def test_token_files(spark, encoder):
    rows = [(5, "Hello, world"), (2, None), (None, "x"), (5, "again"), (3, ""), (1, "long " * 20000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    got = sorted(tokenstore.read_tokens(tokenstore.write_tokens(df, tokenizer_path(), 2)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 5, 5]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    plain = {r: [*encoder.tokenizer.encode(r or "", add_special_tokens=False).ids, 2] for _, r in rows}
    of = [plain[t] for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) if _ != 5]
    assert [r.ids_crc32 for r in got if r.doc_id != 5] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in of]
    assert {r.ids_crc32 for r in got if r.doc_id == 5} == {zlib.crc32(np.array(plain[t], "<u4").tobytes()) for t in ("Hello, world", "again")}
    assert got[1].n_tokens == 20001 and got[2].n_tokens == got[3].n_tokens == 1
    assert tokenstore.read_tokens(tokenstore.write_tokens(df.limit(0), tokenizer_path(), 2)).collect() == []
