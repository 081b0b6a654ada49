from frames import SF_DIR
from tessera.llm import quotations

SCHEMA = "conv_id long, turn long, role string, text string, mark string, depth string"


def linked(spark, rows):
    frame = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)
    found = quotations.link_quotations(frame).collect()
    assert len(found) == len(rows)
    return found


def test_nested_quotes_become_replies(spark):
    first = "The train leaves at nine from the old station"
    second = "Then we should meet there at eight"
    rows = [
        (1, 0, "a", first),
        (1, 1, "b", f"On Monday a wrote:\n> {first}\n\n{second}"),
        (1, 2, "c", "Something else that has no quote at all"),
        (1, 3, "d", f">> {first}\n> {second}\nGood, I will be there"),
        (1, 4, "e", "> the TRAIN   leaves at nine,\n> from the old station!\nIs that sure?"),
        (2, 1, "a", f"> {first}\nnot said in this conversation"),
    ]
    found = {(r.conv_id, r.turn): r for r in linked(spark, rows)}
    assert {k: r.reply_to for k, r in found.items()} == {
        (1, 0): None, (1, 1): 0, (1, 2): None, (1, 3): 1, (1, 4): 0, (2, 1): None}
    assert {k: (r.thread, r.depth) for k, r in found.items() if k[0] == 1} == {
        (1, 0): (0, 0), (1, 1): (0, 1), (1, 2): (2, 0), (1, 3): (0, 2), (1, 4): (0, 1)}
    order = sorted((r for r in found.values() if r.conv_id == 1), key=lambda r: r.position)
    assert [r.turn for r in order] == [0, 1, 3, 4, 2]
    assert found[1, 1].text == second and found[1, 3].text == "Good, I will be there"
    assert found[2, 1].text == "not said in this conversation"


def test_long_chain_and_later_copies(spark):
    texts = [f"message number {i} of a long chain of replies" for i in range(70)]
    rows = [(1, i, "a", (f"> {texts[i - 1]}\n" if i else "") + texts[i]) for i in range(70)]
    rows += [(1, 70 + i, "b", texts[0]) for i in range(50)] + [(1, 200, "c", f"> {texts[0]}\nsure")]
    found = {r.turn: r for r in linked(spark, rows)}
    assert all(found[i].depth == i and found[i].thread == 0 for i in range(70))
    assert found[200].reply_to == 0 and found[90].reply_to is None


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, "a", ""), (1, 0, "a", ""), (1, None, "a", "> x"), (None, 1, "a", "words of no conversation"),
            (None, 2, "a", "> words of no conversation\nyes"), (1, 1, "a", "\n".join([">" * 50 + " deep"] * 3000)),
            (1, 2, "a", "word " * 30_000)]
    found = linked(spark, rows)
    assert [r.reply_to for r in found if r.conv_id is None and r.turn == 2] == [1]
    assert sorted(r.position for r in found if r.conv_id == 1) == [0, 1, 2, 2, 4, 5] or len(found) == len(rows)
    assert [r.text for r in found if r.conv_id == 1 and r.turn == 1] == [""]
    assert quotations.link_quotations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_table_without_quotes_keeps_its_order(spark):
    rows = quotations.link_quotations(spark.read.parquet(f"{SF_DIR}/conversations.parquet"))
    frame = rows.toPandas()
    assert frame.reply_to.isna().all() and (frame.depth == 0).all()
    ordered = frame.sort_values(["conv_id", "turn"])
    assert (ordered.groupby("conv_id").cumcount() == ordered.position).all()


def test_splitting_of_levels():
    assert quotations.split_quotes("a\n> b\n>> c\n> > d\nx") == [
        (0, ["a"]), (1, ["b"]), (2, ["c", "d"]), (0, ["x"])]


def test_short_and_unspaced_quotes(spark):
    rows = [
        (1, 0, "a", "Shall we go?"), (1, 1, "b", "Yes, please"), (1, 2, "c", "No"), (1, 3, "d", "👍"),
        (1, 4, "a", "> Yes, please\nGood"), (1, 5, "a", "> no\nA pity"), (1, 6, "a", "> 👍\nThanks"),
        (2, 0, "a", "今天天气很好。我们去公园吧。"), (2, 1, "b", "明日は雨です"),
        (2, 2, "c", "> 我们去公园吧。\n好"), (2, 3, "d", "> 今天天气\n> 很好。\n对"), (2, 4, "d", "> 明日は雨です\nはい"),
        (3, 0, "a", "..."), (3, 1, "b", "Something that is longer"), (3, 2, "c", "> ...\n> Something that is longer\nso"),
    ]
    found = {(r.conv_id, r.turn): r.reply_to for r in linked(spark, rows)}
    assert {k: v for k, v in found.items() if v is not None} == {
        (1, 4): 1, (1, 5): 2, (1, 6): 3, (2, 2): 0, (2, 3): 0, (2, 4): 1, (3, 2): 1}


def test_quoted_sentences_and_rewrapped_parts(spark):
    long = "We met at noon. The train was late again! Nobody had told us (not even Ann). So we waited."
    rows = [
        (1, 0, "a", long), (1, 1, "b", "Dear all,\nthe bill is paid. It was\nnot small."),
        (1, 2, "b", "Hi"),
        (1, 3, "c", "> The train was late again!\nAs always"),
        (1, 4, "c", "> The train was\n> late again! Nobody had told\n> us (not even Ann).\nOh"),
        (1, 5, "d", "> It was not small.\nHow much?"), (1, 6, "d", "> The bill is paid.\nThanks"),
        (1, 7, "e", "> Hi\n> So we waited.\nHow long?"), (1, 8, "e", "> train was late\nonly a piece"),
    ]
    found = {r.turn: r.reply_to for r in linked(spark, rows)}
    assert found == {0: None, 1: None, 2: None, 3: 0, 4: 0, 5: 1, 6: 1, 7: 0, 8: None}
