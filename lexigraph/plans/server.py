"""The five queries of the reader, over a snapshot."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.operators import search, trees
from lexigraph.runtime import materialize


class Reader:
    """Answers requests by path as DataFrames, or as nested Python values with `answer`. Indexes are made once and kept as files."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.langs, self.items, self.edges, self.below = (tables[k] for k in ("langs", "items", "edges", "descendant_langs"))
        self.lang_index = materialize(search.lang_index(self.items, self.langs))
        self.term_index = materialize(search.term_index(self.items).sortWithinPartitions("lang_id", "lowered"))
        self._trees: dict[str, list[dict]] = {}

    def search_langs(self, name: str) -> DataFrame:
        return search.search_langs(self.lang_index, name).select("lang_id", "name", "similarity", "n_items")

    def search_items(self, lang_id: int, term: str) -> DataFrame:
        hits = search.search_terms(self.term_index, lang_id, term)
        return hits.join(trees.item_records(self.items, self.langs).withColumnRenamed("term", "shown"), F.col("item_id") == F.col("id")).orderBy(F.char_length("term"), F.col("term").desc(), "ety_num", "item_id")

    def tree(self, path: str) -> DataFrame:
        """The rows of an etymology, descendants or cognates path; an item or language that isn't there gives none."""
        asked = trees.parse_path(path)
        if asked is None:
            raise ValueError(f"no tree has the path {path}")
        if asked["kind"] == "etymology":
            return trees.etymology_nodes(self.edges, self.items, self.langs, asked["item"])
        return trees.descendants_nodes(self.edges, self.items, self.langs, self.below, asked["kind"], asked["item"], asked["dist_lang"], asked["desc_langs"])

    def tree_langs(self, path: str) -> DataFrame:
        """(lang_id, name), distinct: the languages in a tree."""
        return trees.tree_langs(self.tree(path), self.items, self.langs).select("lang_id", "name").distinct()

    def find_item(self, path: str, item: int) -> DataFrame:
        """The first row of an item in each tree of a path."""
        return trees.find_item(self.tree(path), item)

    def answer(self, path: str):
        """The nested answer to a path: /search/lang, /search/item/<lang>, or a tree, which is kept."""
        from urllib.parse import parse_qs, urlsplit

        parts = urlsplit(path)
        names, asked = [p for p in parts.path.split("/") if p], parse_qs(parts.query)
        if names[:2] == ["search", "lang"]:
            return [{"id": r["lang_id"], "name": r["name"]} for r in self.search_langs(asked.get("name", [""])[0]).collect()]
        if names[:2] == ["search", "item"]:
            rows = self.search_items(int(names[2]), asked.get("term", [""])[0])
            return [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("id", "etyNum", "lang", "term", "imputed", "reconstructed", "url", "pos", "gloss", "romanization"), {"ignoreNullFields": "false"})).collect()]
        if path not in self._trees:
            kind = names[0]
            self._trees[path] = trees.to_json(self.tree(path), "parents" if kind == "etymology" else "children")
        found = self._trees[path]
        return found if names[0] == "cognates" else (found[0] if found else None)


def item_ids(items: DataFrame, langs: DataFrame, term: str, lang: str) -> DataFrame:
    return items.where(F.col("term") == term).join(F.broadcast(langs.where(F.col("name") == lang)), "lang_id", "left_semi").select("item_id").orderBy("item_id")


def head_sources(edges: DataFrame) -> DataFrame:
    """(item_id, source): the head parent of each item with one."""
    return edges.where("head").select(F.col("child").alias("item_id"), F.col("parent").alias("source"))


def ancestor_set(edges: DataFrame, item: int) -> DataFrame:
    from lexigraph.operators.graph import ancestor_edges

    return ancestor_edges(edges, edges.sparkSession.createDataFrame([(item,)], "id long")).select(F.col("parent").alias("item_id")).distinct()


def relatives_above(edges: DataFrame, items: DataFrame, progenitors: DataFrame, head: int, lang_id: int) -> DataFrame:
    """All items of a language that share a head progenitor, with all their ancestors."""
    from lexigraph.operators.graph import ancestor_edges

    own = progenitors.where(F.col("head") == head).join(items.where(F.col("lang_id") == lang_id), "item_id", "left_semi").select(F.col("item_id").alias("id"))
    own = materialize(own)
    return own.select(F.col("id").alias("item_id")).unionByName(ancestor_edges(edges, own).select(F.col("parent").alias("item_id"))).distinct()


def expansion(edges: DataFrame, items: DataFrame, item: int, only: DataFrame | None, last_lang: int | None) -> DataFrame:
    """The tree of head children below an item, through the items in `only` if given, ending at items of last_lang."""
    from lexigraph.operators.trees import descendants_tree

    step = edges.where("head")
    if only is not None:
        step = step.join(only.select(F.col("item_id").alias("child")), "child", "left_semi")
    if last_lang is not None:
        step = step.join(items.where(F.col("lang_id") == last_lang).select(F.col("item_id").alias("parent")), "parent", "left_anti")
    return descendants_tree(step, edges.sparkSession.createDataFrame([(item,)], "id long"))


def distinct_terms(items: DataFrame, langs: DataFrame, path: str | None = None) -> DataFrame:
    """Distinct (lang, pos, term), sorted; written as CSV if a path is given."""
    rows = items.where("not is_imputed").join(F.broadcast(langs.select("lang_id", F.col("name").alias("lang"))), "lang_id").select("lang", F.explode("pos").alias("pos"), "term").distinct().orderBy("lang", "pos", "term")
    if path:
        rows.write.mode("overwrite").csv(path, header=True)
    return rows
