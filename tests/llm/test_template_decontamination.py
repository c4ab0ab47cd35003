import numpy as np

from tests.llm.common import clashing, documents, edge_rows, sentence
from tramline.llm import template_decontamination as T

ITEM = (
    "A train with 120 passengers leaves Basel at 9 in the morning and travels 85 km to the lake where Anna buys 3 tickets "
    "for 12 dollars each before she walks 2 km to the old mill and counts how much money is left from 50 dollars."
)
OTHER = (
    "A train with 300 passengers leaves Genf at 7 in the morning and travels 64 km to the lake where Maria buys 5 tickets "
    "for 9 dollars each before she walks 4 km to the old mill and counts how much money is left from 80 dollars."
)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def found(spark, rows, items, **parameters):
    return {(r.doc_id, r.item_id): (r.windows, r.item_windows, r.copied) for r in
            T.leaks(documents(spark, rows), benchmark(spark, items), **parameters).collect()}


def test_placeholders():
    tokens = T.Tokens([b"Tom has 3 apples. If Ann gives 2.5 kg to Bob, how many? It is \xc3\x9cber 1,200 km \xe2\x80\x9cquoted\xe2\x80\x9d x"])
    assert tokens.counts.tolist() == [20]
    slots = {k: tokens.template[k] for k in np.flatnonzero(tokens.slot)}
    assert set(slots) == {2, 5, 7, 8, 10, 15, 16, 17}  # 3, Ann, 2.5, kg, Bob, Über, 1,200, km
    assert {slots[k] for k in (2, 7, 16)} == {T._NUMBER} and {slots[k] for k in (8, 17)} == {T._UNIT}
    plain = T.Tokens([b"quoted \xc3\xbcber"]).literal
    assert tokens.literal[18] == plain[0] and tokens.literal[15] == plain[1]


def test_copies_and_new_parameters_are_found(spark):
    rows = [
        (1, f"{sentence(1)} {ITEM} {sentence(2)}"), (2, sentence(3)), (3, OTHER), (4, ITEM.upper()), (5, f"junk*** {ITEM.replace(' ', ' ||| ')}"),
        (6, " ".join(ITEM.split()[:12])), (7, None),
    ]
    hits = found(spark, rows, [(10, ITEM), (11, sentence(50))])
    assert set(hits) == {(1, 10), (3, 10), (4, 10), (5, 10)}
    windows, of, copied = hits[1, 10]
    assert windows == of == copied
    assert hits[3, 10][2] < hits[3, 10][0]


def test_slots_must_agree(spark):
    """A value that is there twice must become one value twice."""
    item = "first take 7 red stones and then take 7 blue stones and now put 7 more stones in a small box"
    same = item.replace("7", "9")
    torn = item.replace("7", "9", 1).replace("7", "4", 1).replace("7", "5", 1)
    hits = found(spark, [(1, same), (2, torn)], [(1, item)])
    assert set(hits) == {(1, 1)}


def test_names_that_begin_sentences_are_replaced(spark):
    item = (
        "Maria has 12 apples. Maria buys 5 more apples at the market. Maria gives 3 apples to her brother. "
        "How many apples does she have left?"
    )
    rows = [
        (1, item.replace("Maria", "Peter")), (2, f"{sentence(1)}. {item.replace('Maria', 'Zoé').replace('12', '40')} {sentence(2)}"),
        (3, item.replace("Maria", "Peter", 1).replace("Maria", "Anna", 1).replace("Maria", "Tom", 1)),
    ]
    hits = found(spark, rows, [(1, item), (2, sentence(60))])
    assert set(hits) == {(1, 1), (2, 1)}
    windows, of, copied = hits[1, 1]
    assert windows > 0.8 * of and copied == 6


def test_items_shorter_than_a_window_are_found_as_whole_copies(spark):
    items = [(1, "What is seven times eight?"), (2, "Capital of Peru"), (3, "zyzzyva"), (4, sentence(9, 7)), (5, "")]
    rows = [
        (1, f"{sentence(1)} what is SEVEN times eight {sentence(2)}"), (2, "capital of Peru"), (3, "capital of new Peru"),
        (4, "a zyzzyva, and a zyzzyva"), (5, sentence(9, 7)), (6, sentence(9, 6)), (7, "What is seven times"), (8, None),
    ]
    hits = found(spark, rows, items)
    assert hits == {(1, 1): (1, 1, 1), (2, 2): (1, 1, 1), (4, 3): (1, 1, 1), (5, 4): (1, 1, 1)}


def test_scripts_without_spaces_are_read_by_character(spark):
    texts = ["小明有12个苹果，他又买了五个。", "東京は日本の首都です。", "カタカナ、ﾊﾝｶｸ「々」", "ภาษาไทย", "x漢y 𠀀𠀁"]
    counts = T.Tokens([t.encode() for t in texts]).counts.tolist()
    assert counts == [13, 10, 9, 7, 5]
    item = "小明有很多苹果，他又买了五个橙子，一共花了二十元。"
    rows = [(1, f"前文很长。{item}后文也很长。"), (2, "小明没有苹果，也没有橙子。今天天气很好，我们去公园玩。"), (3, "我说東京です。"), (4, "東京")]
    assert set(found(spark, rows, [(1, item), (2, "東京です")])) == {(1, 1), (3, 2)}


def test_half_an_item_and_long_passages(spark):
    long = sentence(7, 200)
    rows = [(1, " ".join(long.split()[:30])), (2, " ".join(long.split()[:20])), (3, " ".join(long.split()[50:160]))]
    assert set(found(spark, rows, [(1, long)])) == {(1, 1), (3, 1)}
    short = sentence(8, 16)
    assert set(found(spark, [(1, " ".join(short.split()[:13])), (2, " ".join(short.split()[:10]))], [(1, short)])) == {(1, 1)}


def test_equal_to_plain_python_on_given_documents(spark):
    """Documents that hold the words of an item in a row, and no others, on the given tables."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    import re

    plain = lambda text: f" {' '.join(re.findall(r'[^\W_]+', text.lower()))} "
    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    wanted = {(d, r.item_id) for r in items.collect() for d, text in texts.items() if plain(r.text) in text}
    assert wanted and {(r.doc_id, r.item_id) for r in T.leaks(docs, items).collect()} == wanted


def test_unusual_rows(spark):
    rows = [*edge_rows(), (77, ITEM), (77, ITEM), (None, ITEM)]
    items = [(1, ITEM), (2, None), (3, ""), (4, "too short"), (None, OTHER), (5, ITEM)]
    for docs in (documents(spark, rows), clashing(spark, rows)):
        hits = {(r.doc_id, r.item_id) for r in T.leaks(docs, benchmark(spark, items)).collect()}
        assert hits == {(d, i) for d in (77, None) for i in (1, 5, None)}
        stay = T.drop_leaks(docs, benchmark(spark, items))
        assert stay.columns == docs.columns and stay.count() == len(edge_rows())
    assert T.leaks(documents(spark, []), benchmark(spark, items)).count() == 0
    assert T.leaks(documents(spark, rows), benchmark(spark, [])).count() == 0
    assert T.drop_leaks(documents(spark, rows), benchmark(spark, [])).count() == len(rows)
