"""Alias expansion over repeated catalogue entries."""

from shelfmark.catalog import Tables, matching
from shelfmark.plans import search as P

TITLES = [(i, 0, "Blue Ring") for i in range(3, 90)] + [(i, 1, "Acme Blue Ring") for i in range(3, 90)] + [
    (1, 0, "Blue Rings"), (1, 1, "Acme Blue Ring"), (2, 1, "Never Preferred"), (None, 0, "Blue Ring"), (100, 0, "Blue Ring")]


def test_items_of_one_set_of_titles_are_one_row(spark):
    rows = P.title_sets(spark.createDataFrame(TITLES, "item_id long, pos int, title string")).collect()
    assert sorted((r["item_id"], r["preferred"], len(r["titles"])) for r in rows) == [(1, "Blue Rings", 2), (3, "Blue Ring", 2), (100, "Blue Ring", 1)]


def test_choices_do_not_depend_on_repeated_items(spark):
    queries = spark.createDataFrame([(1, "blu ring"), (2, "acme blue ring"), (3, "unrelated words")], "query_id long, query string")

    def chosen(titles):
        rows = P.alias_choices(queries, spark.createDataFrame(titles, "item_id long, pos int, title string")).collect()
        return sorted((r["query_id"], r["item_id"], r["alias_rank"], r["preferred"], round(r["score"], 9)) for r in rows)

    once = [t for t in TITLES if t[0] in (1, 2, 3, 100)]
    assert chosen(TITLES) == chosen(once) != []


def test_the_alias_index_is_written_once_for_all_searches(spark, monkeypatch):
    written, kept = [], matching.materialize
    monkeypatch.setattr(matching, "materialize", lambda df, name: written.append(name) or kept(df, name))
    tables = Tables(spark, "/root/testdata/sf0.001")
    search = matching.part_search(tables)
    queries = matching.title_queries(tables.part).limit(4)
    assert search(queries).schema == search(queries).schema
    assert written == ["alias-index"]
