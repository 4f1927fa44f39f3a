from caseweave.llm.decontamination import find_contamination

ITEMS = [
    (1, "A farmer named Peter Smith has 120 apples and sells 35 apples to Maria. How many apples does Peter Smith have left?"),
    (2, "The quick brown fox jumps over the lazy dog while seventeen small birds sing in the old tree."),
    (3, "Water boils at 100 degrees when the pressure is one bar, so what happens at 250 kPa of pressure in the pot?"),
    (4, "short item text of six"), (5, ""), (6, None), (7, "two words"),
]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def pairs(docs, items):
    return {(r.doc_id, r.item_id): r.exact for r in find_contamination(docs, items).collect()}


def test_questions_with_other_numbers_and_names(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = [
        "noise before. " + ITEMS[0][1] + " noise after",
        "Intro words. A farmer named Anna has 77 apples and sells 12 apples to Kim Lee Young. How many apples does Anna have left? More.",
        # The name changes within the question: the same form, but not the same question.
        "Intro. A farmer named Anna has 77 apples and sells 77 apples to Maria. How many apples does Boris have left? More.",
        "THE QUICK brown fox; nothing else here to see at all in this long text about other things entirely.",
        "so " + ITEMS[1][1].lower() + " and more", None, "", "pre " + ITEMS[3][1] + " post",
        "Water boils at 212 degrees when the pressure is one bar, so what happens at 3 kPa of pressure in the pot?",
    ]
    found = pairs(docs_of(spark, texts), items)
    assert found.get((0, 1)) is True and found.get((1, 1)) is False
    assert (4, 2) in found and (7, 4) in found and found.get((8, 3)) is False
    assert {d for d, _ in found} <= {0, 1, 2, 4, 7, 8} and (3, 2) not in found
    # Of the three values in item 1 only the first name is inconsistent in text 2.
    assert (2, 1) not in found


def test_benchmark_in_documents(spark):
    """Items planted whole are found; the brute-force test is that the item's words stand in the text in order."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    texts = {r.doc_id: " ".join((r.text or "").split()) for r in docs.collect()}
    want = {
        (d, r.item_id) for r in items.collect() for d, t in texts.items() if " ".join(r.text.split()) in t
    }
    assert want and set(pairs(docs, items)) == want


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame(
        [(1, "word1 and1, 12.5 word2 and2, 12.5 word3 and3, 12.5 word4 and4, 12.5", "x"), (2, None, "x")],
        "item_id long, text string, doc_id string",
    )
    assert set(pairs(odd, items)) == {(4, 1)}
    assert pairs(none, items) == {} and pairs(odd, items.limit(0)) == {}


def test_item_after_another_problem_of_its_form(spark):
    """The item stands whole behind sentences of the same template with other numbers and names."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    other = "A farmer named Anna has 77 apples and sells 12 apples to Kim. How many apples does Boris have left? "
    texts = [
        "Some lines. " + other * 3 + "The rest is another story. " + ITEMS[0][1] + " The end.",
        "Some lines. " + other * 3, "Some lines. " + other + "More of them. " + ITEMS[2][1],
        ITEMS[0][1] + " " + other,
    ]
    found = pairs(docs_of(spark, texts), items)
    assert found[(0, 1)] is True and found[(3, 1)] is True and found[(2, 3)] is True
    assert (1, 1) not in found and (2, 1) not in found


def test_item_with_a_word_put_in(spark):
    """Windows before and behind the word meet at two alignments; an earlier problem shares some of them."""
    item = "A baker named Ruth has 40 loaves in the shop and gives 9 loaves to Omar before the clock in the tower of the town strikes noon. "
    item += "Then a woman named Edith walks in and asks for 3 loaves with seeds, so how many loaves stay on the long shelf of the shop that day?"
    other = "A baker named Ivan has 88 loaves in the shop and gives 5 loaves to Lena before the clock in the tower of the town strikes noon. "
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    put_in = item.replace("Then a woman", "Then suddenly a woman")
    assert pairs(docs_of(spark, [other + put_in, put_in, other]), items) == {(0, 1): True, (1, 1): True}


def test_items_of_names_and_numbers_and_short_ones(spark):
    """Few or no windows of such items count; as they are written they are found nevertheless."""
    table = "Ann 3 kg Bob 5 kg Carl 7 kg Dora 9 kg Emil 11 kg Fritz 13 kg Gerd 15 kg"
    mixed = table + " and the whole of it was put on the old scale by the door of the mill"
    items = spark.createDataFrame(
        [(1, table), (2, mixed), (3, "speed of light"), (4, "Yes"), (5, "12, 13, 14, 15 and 16"), (6, "..."), (7, "")],
        "item_id long, text string",
    )
    texts = [
        "Weights: " + table + ". End.", "so " + mixed + " again", "The Speed of Light, 12 13 14 15 and 16.",
        table.replace("7", "8"), "the speed of the light; yesterday 12 13 14 15 and", "yes", "",
    ]
    found = find_contamination(docs_of(spark, texts), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 1), (1, 1), (1, 2), (2, 3), (2, 5), (5, 4)}
    assert all(r.exact and r.n_found == r.n_windows for r in found)
