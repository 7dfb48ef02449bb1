"""Ranking quality of the four configurations: the published figures where their catalogue is at hand, and one of our own."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.operators import evaluate
from tessera.plans import index as index_plan
from tessera.plans import search as search_plan
from tessera.plans.config import Config
from tessera.sources.catalogs import FileSource, load_golden

CONFIGS = {
    "dense": Config(hybrid=False, reranker="none", coverage_weight=0.0),
    "hybrid": Config(reranker="none", coverage_weight=0.0),
    "rerank": Config(coverage_weight=0.0),
    "coverage": Config(),
}
#: Fixed values, as published: Hit@1, Recall@5, MRR, nDCG@5.
PUBLISHED = {"dense": (0.739, 0.913, 0.812, 0.837), "hybrid": (0.870, 1.000, 0.920, 0.940), "rerank": (0.913, 1.000, 0.949, 0.962), "coverage": (0.957, 1.000, 0.978, 0.984)}
#: The catalogue and the labelled queries of the published evaluation, which are not part of this repository.
CATALOGUE, GOLDEN = os.environ.get("TESSERA_EVAL_CATALOGUE", ""), os.environ.get("TESSERA_EVAL_GOLDEN", "")

ABOUT = {
    "postbox": ("Send and read electronic mail", ["send_message: Send an email to someone", "list_inbox: Show unread messages"]),
    "atlas": ("Maps, routes and places", ["find_route: Directions between two addresses", "search_places: Restaurants and shops nearby"]),
    "ledger": ("Invoices and payments of a small business", ["create_invoice: Bill a customer", "list_payments: Show what was paid"]),
    "skycast": ("Weather forecasts and warnings", ["forecast: Rain and temperature for a city", "alerts: Storm warnings"]),
    "shelf": ("Query a relational database", ["run_sql: Execute a select statement", "describe_table: Show the columns of a table"]),
    "branchly": ("Code hosting, issues and pull requests", ["open_issue: Report a bug in a repository", "merge_pull_request: Merge reviewed code"]),
    "notebook": ("Personal notes and documents", ["write_note: Save a note", "search_notes: Find text in documents"]),
    "calends": ("Calendar, meetings and reminders", ["create_event: Schedule a meeting", "free_slots: Find a time when everybody is free"]),
    "lens": ("Look at pictures and describe them", ["describe_image: Say what is on a photo", "resize_image: Make an image smaller"]),
    "babel": ("Translate texts between languages", ["translate: Turn a sentence into another language", "detect_language: Name the language of a text"]),
    "crate": ("Containers and their logs", ["restart_container: Restart a service", "read_logs: Show recent log lines"]),
    "trader": ("Stock prices and company figures", ["quote: Latest price of a share", "earnings: Quarterly revenue of a company"]),
    "courier": ("Parcels and shipping labels", ["track_parcel: Where a shipment is", "print_label: Make a shipping label"]),
    "herald": ("News of the day", ["headlines: Top stories", "search_articles: Articles about a topic"]),
    "forge": ("Run programs in a sandbox", ["run_python: Execute a script", "install_package: Add a library"]),
    "chorus": ("Team chat and channels", ["post_message: Write into a channel", "list_channels: Show the rooms of a team"]),
}
ASKED = {
    "send an email to my landlord": "postbox", "unread messages in my inbox": "postbox", "directions to the airport": "atlas", "restaurants nearby": "atlas", "bill a customer for work": "ledger", "will it rain tomorrow": "skycast",
    "execute a select statement on the database": "shelf", "columns of a table": "shelf", "report a bug in the repository": "branchly", "merge code after review": "branchly", "save a note for later": "notebook",
    "schedule a meeting with the team": "calends", "find a time when we are all free": "calends", "what is on this photo": "lens", "translate a sentence into French": "babel", "show recent log lines of a service": "crate",
    "latest price of a share": "trader", "where is my shipment": "courier", "top stories of today": "herald", "run a python script": "forge", "write into the team channel": "chorus",
}


def figures(spark, index, golden, config):
    asked = golden.select("qid", "query", F.lit(5).alias("top_k"), F.lit(0.0).alias("min_score"), F.array().cast("array<string>").alias("categories"), F.lit("").alias("source"))
    ranked = search_plan.search(asked, index, config).select("qid", "rank", "id")
    r = evaluate.report(evaluate.per_query(golden, ranked, 5)).first()
    return tuple(round(r[c], 3) for c in ("hit_at_1", "recall_at_k", "mrr", "ndcg_at_k"))


@pytest.fixture(scope="module")
def own(tmp_path_factory):
    folder = tmp_path_factory.mktemp("catalogue")
    tool = lambda t: dict(zip(("name", "description"), t.split(": ")))
    (folder / "catalogue.json").write_text(json.dumps([{"name": n, "title": n.title(), "description": d, "tools": list(map(tool, t))} for n, (d, t) in ABOUT.items()]))
    (folder / "golden.json").write_text(json.dumps([{"query": q, "expected": [n]} for q, n in ASKED.items()]))
    return folder


def test_our_own_catalogue(spark, own):
    """Each part of the ranking earns its place."""
    index = index_plan.build(FileSource(str(own / "catalogue.json")).fetch(spark)).persist()
    golden = load_golden(spark, str(own / "golden.json")).persist()
    got = {name: figures(spark, index, golden, c) for name, c in CONFIGS.items()}
    assert got["dense"][0] < got["rerank"][0] and got["hybrid"][1] >= got["dense"][1] and got["coverage"][0] >= got["rerank"][0]
    assert got["coverage"][0] >= 0.9 and got["coverage"][1] == 1.0 and got["coverage"][2] >= 0.93, got
    indexed = index.with_retrieval(share=1.0)
    assert figures(spark, indexed, golden, Config(retrieval="index")) == got["coverage"]


def test_eval_command_with_a_catalogue(spark, own):
    """A catalogue file in the place of an index: it is indexed first."""
    card = cli.run_eval(spark, Config(), None, str(own / "golden.json"), fixtures=str(own / "catalogue.json"))
    assert card.startswith(f"n={len(ASKED)} Hit@1=0.9") or card.startswith(f"n={len(ASKED)} Hit@1=1.")
    with pytest.raises(ValueError, match="index or a catalogue"):
        cli.run_eval(spark, Config(), None, str(own / "golden.json"))


@pytest.mark.skipif(not (CATALOGUE and GOLDEN), reason="TESSERA_EVAL_CATALOGUE and TESSERA_EVAL_GOLDEN do not name the published files")
@pytest.mark.parametrize("name", CONFIGS)
def test_published_figures(spark, name):
    index = index_plan.build(FileSource(CATALOGUE).fetch(spark), CONFIGS[name])
    assert figures(spark, index, load_golden(spark, GOLDEN), CONFIGS[name]) == PUBLISHED[name]
