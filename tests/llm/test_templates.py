"""Decontamination: templates as classes of items, and all of it against a plain version over all pairs."""

import random

import pandas as pd

from larder.llm import decontaminate as D


def tokens(text):
    """(type, template word, core) of each token of a text, word by word."""
    out, opens = [], True
    maker = D.Templates()
    for word in (text or "").encode().split():
        code = maker.code(word)
        core = word.strip(D.EDGES).lower()
        if code & ~15:
            kind = D.NAME if code & 2 and not opens else code >> 2 & 3
            out.append((kind, core.decode().lower() if kind == D.LITERAL_TYPE else f"<{kind}>", core))
        opens = bool(code & 1)
    return out


def renamed(pairs):
    to, back = {}, {}
    for (kind, _, a), (_, _, b) in pairs:
        if kind != D.LITERAL_TYPE and (to.setdefault((kind, a), b) != b or kind == D.NAME and back.setdefault(b, a) != a):
            return False
    return True


def meets(doc, item):
    """Whether a document leaks an item: every diagonal, every window, compared one by one."""
    size = min(D.WINDOW, len(item))
    if size < D.LEAST:
        return False
    for shift in range(-len(item), len(doc)):
        at = lambda w, s=shift: [(item[p], doc[p + s]) for p in range(w, w + size)]
        windows = [w for w in range(len(item) - size + 1) if 0 <= w + shift and w + size + shift <= len(doc) and sum(k == D.LITERAL_TYPE for k, _, _ in item[w : w + size]) >= D.LITERAL and all(a[1] == b[1] for a, b in at(w))]
        every = lambda ws, s=shift: [(item[p], doc[p + s]) for p in sorted({p for w in ws for p in range(w, w + size)})]
        if not windows:
            continue
        if not renamed(every(windows)):
            windows = [w for w in windows if renamed(at(w))]
            if not renamed([x for x in every(windows) if x[0][0] == D.NAME]):
                windows = [w for w in windows if all(a[2] == b[2] for a, b in at(w))]
                if not windows or windows[0] + size > windows[-1]:
                    continue
        if windows and (sum(a[0] == D.LITERAL_TYPE for a, _ in every(windows)) >= D.EVIDENCE or len(every(windows)) == len(item)):
            return True
    return False


def check(spark, docs, items):
    read = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string").repartition(3)
    table, benchmark = read(docs, "doc_id"), read(items, "item_id")
    template = {r["item_id"]: r["template"] for r in D.item_templates(benchmark).collect()}
    parsed = [(j, tokens(t)) for j, t in items]
    want = {(i, template[j]) for i, t in docs for d in [tokens(t)] for j, x in parsed if meets(d, x)}
    found = D.leaks(table, benchmark).collect()
    assert {(r["doc_id"], r["template"]) for r in found} == want and all(template[r["item_id"]] == r["template"] for r in found)
    left = {r["doc_id"] for r in D.without_leaks(table, benchmark).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want}
    return want, found


def test_plain(spark, small):
    docs, items = pd.read_parquet(f"{small}/documents.parquet"), pd.read_parquet(f"{small}/benchmark.parquet")
    chosen = docs[docs.text.str.len() < 1500]
    assert check(spark, list(zip(chosen.doc_id.tolist(), chosen.text)), list(zip(items.item_id.tolist(), items.text)))[0]


def test_plain_on_renamings(spark):
    rng = random.Random(2)
    names, nouns = ["Ann", "Bob", "Cy", "Dee"], "apples stones boats birds lamps".split()

    def item(i):
        r = random.Random(i % 6)
        body = [r.choice(["the", "gave", "to", "and", "then", "<n>", "<d>", "took", "from", "again", r.choice(nouns)]) for _ in range(r.randint(4, 24))]
        return " ".join({"<n>": rng.choice(names), "<d>": str(rng.randint(1, 9))}.get(w, w) for w in ["so", *body])

    items = [(i, item(i)) for i in range(40)]
    docs = [(i, " ".join(["well", item(rng.randrange(40)) if rng.random() < 0.7 else "", "some other words follow", item(rng.randrange(40)), "end"])) for i in range(60)]
    want, _ = check(spark, docs, items)
    assert len(want) > 30


def test_many_of_one_template_are_few_rows(spark):
    """300 items and 300 documents of one template: a row for each document, and one for each item."""
    ask = lambda a, b: f"What is the sum of {a} and {b} if both of them are counted together once more"
    items = [(i, ask(1000 + i, 5000 + i)) for i in range(300)] + [(300, ask(7, 7))]
    docs = [(i, f"He asked: {ask(2000 + 3 * i, 9000 + i)} and left") for i in range(299)] + [(299, f"so {ask(1007, 5007)} end"), (300, f"so {ask(3, 3)} end")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert len({(r["doc_id"], r["template"]) for r in found}) == len(found) and len(found) <= 2 * 301  # two templates
    assert {r["doc_id"] for r in found} == set(range(301))
    assert 7 in [r["item_id"] for r in found if r["doc_id"] == 299 and r["exact"]]
    sizes = D.item_templates(benchmark).groupBy("template").count().collect()
    assert sorted(r["count"] for r in sizes) == [1, 300]


def test_renamed_item_of_many_is_told_by_its_words():
    """Names that don't fit one renaming leak only where one item has two separate windows word for word."""
    filler = "and so the long story goes on without any change at all until the very last of its many quiet pages is read"
    said = lambda a, b: f"In spring {a} went down to the river {filler} while later in autumn {b} came back to the house"
    here = D.Slice([(1, said("Alice", "Alice")), (2, said("Zoe", "Zoe"))])
    assert len(here.parsed) == 1
    found = here.matches([said("Zoe", "Eve").encode()])
    # The first half is Zoe's item word for word, the second isn't; the windows between hold no name.
    assert [x[0] for x in found[0]] == [1]
