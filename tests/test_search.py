"""Browse requests through the inverted index equal a scan of the catalogue."""

import random
from decimal import Decimal

from marketspark.operators import catalog as C
from marketspark.operators import search as S

PRODUCT = ("id string, vendor string, name string, description string, category string, price decimal(18,2), "
           "in_stock boolean, review_count int, rating decimal(3,1), pos int")
REQUEST = ("request_id string, vendor string, q string, categories array<string>, max_price decimal(18,2), "
           "in_stock_only boolean, sort string, page string")


def _match(r, p):
    """The pages' filter, product by product."""
    _, vendor, q, cats, most, stock_only, _, page = r
    _, p_vendor, name, text, category, price, in_stock = p[:7]
    if vendor is None or vendor != p_vendor:
        return False
    store = page == "store"
    q = (q or "").strip(" ") if store else (q or "")
    fields = [name, category] if store else [name, category, text]
    if q and not any(q.lower() in f.lower() for f in fields if f is not None):
        return False
    if cats and (category is None or category not in cats):
        return False
    return price <= most and (store or not stock_only or bool(in_stock))


def _tables(seed):
    rnd = random.Random(seed)
    words = ["Rose", "rosé", "Oud", "Amber oil", "a", "", "ab", "Ünder", "musk%", None]
    text = lambda: None if rnd.random() < 0.1 else " ".join(w or "" for w in rnd.choices(words, k=rnd.randint(0, 4)))
    cats = ["oil", "spray", "Oud", None]
    products = [(f"p{i}", rnd.choice(["v1", "v1", "v2", None]), text(), text(), rnd.choice(cats), Decimal(rnd.randint(1, 20)),
                 rnd.choice([True, False, None]), rnd.randint(0, 9), Decimal("4.5"), i) for i in range(60)]
    products += products[:5]                                      # repeated rows
    products.append((products[0][0], "v1", "Rose oil", None, "spray", Decimal(3), True, 1, None, 99))   # an id used twice
    requests = [(f"r{i}", rnd.choice(["v1", "v1", "v2", "v9", None]), rnd.choice(["", None, "ROSE", " oud ", "a", "am", "ber oil", "ü", "zzz", "rosé", "%", "se a"]),
                 rnd.choice([None, [], ["oil"], ["oil", "Oud", "oil"], [None]]), Decimal(rnd.randint(5, 20)), rnd.choice([True, False, None]),
                 rnd.choice(["price-asc", "price-desc", "popular", "rating", "default"]), rnd.choice(["store", "vendor"])) for i in range(80)]
    return products, requests


def test_index_equals_scan(spark):
    for seed in (1, 2):
        products, requests = _tables(seed)
        p, r = spark.createDataFrame(products, PRODUCT), spark.createDataFrame(requests, REQUEST)
        want = sorted((q[0], x[0], x[9]) for q in requests for x in products if _match(q, x))
        m = C.browse_matches(r, p)
        assert sorted((x.request_id, x.id, x.pos) for x in m.collect()) == want and len(want) > 100
        counts = {x.request_id: x.n_results for x in C.browse_counts(r, p).collect()}
        assert counts == {q[0]: sum(w[0] == q[0] for w in want) for q in requests}


def test_a_search_looks_at_few_products(spark):
    """A request for a rare word in a catalogue of one vendor meets the products
    that hold it, and a request by category that category's."""
    p = spark.range(20_000).selectExpr(
        "'p' || id AS id", "'v' AS vendor", "CASE WHEN id % 1000 = 7 THEN 'saffron soap' ELSE 'plain soap' END AS name", "'soap' AS description",
        "'c' || id % 50 AS category", "cast(10 as decimal(18,2)) AS price", "true AS in_stock", "1 AS review_count", "cast(4 as decimal(3,1)) AS rating", "cast(id as int) AS pos")
    r = [("a", "v", "Saffron", None, Decimal(99), False, "default", "store"), ("b", "v", "soap", ["c3"], Decimal(99), False, "default", "vendor"),
         ("c", "v", "", ["c4", "c5"], Decimal(99), False, "default", "store"), ("d", "v", "saffrom", None, Decimal(99), False, "default", "store")]
    met = S.candidates(S.as_searches(spark.createDataFrame(r, REQUEST)), p).groupBy("_q", "_cats").count().collect()
    assert {(x._q, tuple(x._cats)): x["count"] for x in met} == {("saffron", ()): 20, ("soap", ("c3",)): 400, ("", ("c4", "c5")): 800}


def test_empty_tables(spark):
    products, requests = _tables(3)
    p, r = spark.createDataFrame(products, PRODUCT), spark.createDataFrame(requests, REQUEST)
    assert C.browse_matches(r.limit(0), p).count() == 0 and C.browse_matches(r, p.limit(0)).count() == 0
    assert C.browse_counts(r, p.limit(0)).filter("n_results <> 0").count() == 0
