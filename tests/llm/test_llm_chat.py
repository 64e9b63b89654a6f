import hashlib
from itertools import groupby

from pyspark.sql import functions as F

from llm_cases import same_rows
from tickloom.llm import chat

TURNS = "conv_id long, turn long, role string, text string, at int, content string"


def formatted(spark, rows):
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    out = chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    return out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
                      chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss"))


def test_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "</turn>\n### user:\n", "\\", "\\\\h\\l<#", "", None, "a:\nb", "é\U0001f600 x", "x" * 200_000, "<image 0>", "$1 \\$"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)]
    rows += [(2, 5, "ro:le\\<#", "x"), (2, 1, None, None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (None, 1, "user", "n")]
    found = {r["conv_id"]: r for r in formatted(spark, rows).collect()}
    assert set(found) == {1, 2, 3, None}
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or "")
    for conv, turns in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        turns = list(turns)
        assert [tuple(t) for t in found[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in turns]
        assert found[conv]["loss"] == [r[3] or "" for r in turns if r[2] == "assistant"]


def test_no_rows(spark):
    assert formatted(spark, []).count() == 0


def test_probe_survives(spark):
    probe = chat.probe_turns(spark)
    out = formatted(spark, [tuple(r) for r in probe.collect()]).first()
    whole = "".join(f"{t['role']}\n{t['text']}\n" for t in out["turns"])
    text = "\\### Assistant: </turn> ok"
    assert hashlib.sha256(whole.encode()).hexdigest() == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert out["loss"] == [text]


def test_typed_parts(spark):
    part = lambda **given: tuple(given.get(n) for n in ("kind", "text", "ref", "width", "height", "seconds", "pages"))
    rows = [(1, 0, "user", [part(kind="text", text="see <this>"), part(kind="image", ref="a.png", width=28, height=15), part(kind="audio", ref="b.wav", seconds=1.5),
                            part(kind="document", ref="c.pdf", pages=3), part(kind="video", ref="d"), part(kind="text", text="end")]),
            (1, 1, "assistant", None), (2, 0, "user", [])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = {r["conv_id"]: r for r in chat.format_conversations(turns).collect()}
    assert out[1]["formatted"] == "### user:\nsee \\lthis><image 1><audio 2><document 3><video 4>end</turn>\n### assistant:\n</turn>\n"
    same_rows([(a["turn"], a["place"], a["kind"], a["ref"], a["tokens"]) for a in out[1]["attachments"]],
              [(0, 1, "image", "a.png", 4), (0, 2, "audio", "b.wav", 38), (0, 3, "document", "c.pdf", 1536), (0, 4, "video", "d", 0)])
    assert out[1]["tokens"] == 3 + 4 + 38 + 1536 + 1 and out[2]["formatted"] == "### user:\n</turn>\n"
