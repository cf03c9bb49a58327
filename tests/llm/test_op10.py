import random

from barspan.llm.op10_decontamination import decontaminated, leaks

DOC, ITEM = "doc_id long, text string, key string", "item_id long, text string"

QUESTION = "A farmer named Alice Moore sold 45 apples at 3 dollars each, then Alice Moore gave 45 pears to her neighbour Bob before sunset."
OTHER = "A farmer named Carol sold 7,200 apples at 12 euros each, then Carol gave 7,200 pears to her neighbour Dan before sunset."
CROSSED = "A farmer named Carol sold 7 apples at 12 euros each, then Erik gave 9 pears to her neighbour Carol before sunset."


def plain(n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice("ka lo mi nu pe ri so tu va wi xo yu".split()) + rnd.choice("ab cd ef gh".split()) for _ in range(n))


def table():
    passage = plain(40, 1)
    items = [(1, QUESTION), (2, passage), (3, "short one here"), (4, None), (5, ""), (6, "!!"), (None, plain(20, 2)), (2, passage)]
    docs = [
        (10, plain(50, 3) + " " + passage + " " + plain(30, 4), "x"),
        (11, passage.upper().replace(" ", "\n"), None),
        (12, "In the news: " + OTHER, "y"),
        (13, "In the news: " + CROSSED, "y"),
        (14, plain(500, 5), ""),
        (15, " ".join(passage.split()[:14]) + " " + plain(60, 6), "half"),
        (16, " ".join(passage.split()[:9]) + " " + plain(60, 7), "too little"),
        (17, plain(30000, 8) + " " + plain(20, 2), "long"),
        (18, None, "n"),
        (19, "", "e"),
        (None, "x y " + QUESTION.lower(), "no id"),
        (20, "then SHORT, one; here again", "s"),
        (14, plain(500, 5), ""),
        (21, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 Alice Bob Carl", "numbers"),
    ]
    return items, docs


def test_planted_cases(spark):
    items, docs = table()
    got = leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(10, 2), (11, 2), (12, 1), (15, 2), (17, None), (None, 1), (20, 3)}
    by = {(r.doc_id, r.item_id): r for r in got}
    assert by[10, 2].covered == 40 and by[10, 2].first_token == 50 and by[10, 2].last_token == 89
    assert by[12, 1].changed >= 4


def found(spark, items, docs):
    got = leaks(spark.createDataFrame([(i, t, "") for i, t in docs], DOC), spark.createDataFrame(items, ITEM))
    return {(r.doc_id, r.item_id) for r in got.collect()}


def test_renamed_sentence_openers(spark):
    sold = "{} sold {} books. {} sold {} books. {} sold {} books. How many books were sold?"
    lent = "{} made {} caps. {} lent {} pens. {} tore {} maps. How many things were left?"
    items = [(1, sold.format("Tom", 3, "Mary", 4, "Kim", 9)), (2, lent.format("Tom", 3, "Mary", 4, "Kim", 9))]
    docs = [
        (1, "Read this: " + sold.format("Ann", 5, "Bob", 8, "Liz", 6)),
        (2, lent.format("Ann", 5, "Bob", 8, "Liz", 6).replace(". ", "\n")),
        (3, lent.format("Ann", 5, "Bob", 8, "Ann", 6)),  # one person for two
        (4, "Tom slept. Mary read 4 books. Kim ran. How many were there?"),
    ]
    assert found(spark, items, docs) == {(1, 1), (2, 2)}


def test_merged_slots_shorten_an_item(spark):
    plain_short = "Add 2.5 cups of 1.75 each"
    merged = "Ann has 1,200,300.25 and 4,500,600.75 and 7,800,900.50 and 1,100,200.25 in all how much is that"
    items = [(1, "What is 12.5 times 30.25 plus 7.75?"), (2, plain_short), (3, merged)]
    docs = [
        (1, "Tell me this. What is 8.25 times 4.5 plus 99.125? Thanks."),
        (2, "First add 3.25 cups of 8.5 each, then stir."),
        (3, merged.replace("1,", "8,").replace("4,", "5,").replace("7,", "2,")),
        (4, "What is 8.25 minus 4.5 plus 99.125?"),
    ]
    assert found(spark, items, docs) == {(1, 1), (2, 2), (3, 3)}


def test_coinciding_numbers(spark):
    two = "the baker sold {} loaves at dawn then {} rolls at night in all"
    same = "she bought {} apples at {} dollars each how much did she pay"
    crossed = "we mix {0} red and {1} blue with {0} green and {1} black then {2} red and {2} blue with {3} green and {3} black"
    items = [(1, two.format(2, 3)), (2, same.format(3, 3)), (3, crossed.format(2, 3, 4, 5))]
    swapped = "we mix {0} red and {1} blue with {2} green and {3} black then {0} red and {1} blue with {2} green and {3} black"
    docs = [(1, two.format(4, 4)), (2, same.format(5, 12)), (3, crossed.format(6, 7, 8, 8)), (4, swapped.format(6, 7, 8, 9))]
    assert found(spark, items, docs) == {(1, 1), (2, 2), (3, 3)}  # 4 crosses half of the numbers


def test_plain_windows_equal_brute_force(spark):
    import re

    rnd = random.Random(11)
    items = [(i, plain(rnd.randrange(3, 40), 100 + i)) for i in range(20)]
    docs = []
    for d in range(60):
        words = plain(rnd.randrange(0, 80), 500 + d).split()
        for _ in range(rnd.randrange(3)):
            w = rnd.choice(items)[1].split()
            a = rnd.randrange(len(w))
            at = rnd.randrange(len(words) + 1)
            words = words[:at] + w[a : a + rnd.randrange(1, 40)] + words[at:]
        docs.append((d, " ".join(words), None))
    want = set()
    for d, text, _ in docs:
        dw = re.findall("[a-z]+", text)
        for i, t in items:
            iw = re.findall("[a-z]+", t)
            k = min(8, len(iw))
            for shift in range(-len(iw), len(dw)):
                hit = set()
                for q in range(len(iw) - k + 1):
                    if 0 <= q + shift and dw[q + shift : q + shift + k] == iw[q : q + k]:
                        hit |= set(range(q, q + k))
                if hit and (len(hit) >= 13 or 2 * len(hit) >= len(iw)):
                    want.add((d, i))
    got = leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_clean_rows_keep_their_columns(spark):
    items, docs = table()
    out = decontaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    assert out.columns == ["doc_id", "text", "key"]
    assert sorted(r.doc_id for r in out.collect()) == [13, 14, 14, 16, 18, 19, 21]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    assert leaks(docs, items).count() == 0
    assert decontaminated(spark.createDataFrame(table()[1], DOC), items).count() == 14
