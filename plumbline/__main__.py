"""python -m plumbline validate|evaluate|compare|build|screen ...: exit 0 done, 1 invalid, 2 wrong options, 4 document names don't match."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.operators import building, comparing
from plumbline.plans import evaluate
from plumbline.sources import backends, corpus, runs
from plumbline.sources.exam import OptionError, read_exam

RESPONSES = "run_id string, question_id string, status string, body string, latency_ms double"
MANIFEST = "run_id string, profile string, exam_sha256 string, request_config string, run_status string, run_scope string, dataset_revision string, git_dirty boolean"


def _options(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="plumbline")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("validate", "evaluate", "build", "screen"):
        s = sub.add_parser(name)
        s.add_argument("--exam")
        s.add_argument("--corpus", required=True)
        s.add_argument("--allow-corpus-drift", action="store_true")
        s.add_argument("--ledger")
        s.add_argument("--out")
        s.add_argument("--responses")
        s.add_argument("--manifest")
        s.add_argument("--backend-profile")
        s.add_argument("--primary-k", type=int)
        s.add_argument("--eval-k", type=lambda x: [int(i) for i in x.split(",")])
        s.add_argument("--skip-name-check", action="store_true")
        s.add_argument("--window", type=int, default=200)
        s.add_argument("--overlap", type=int, default=50)
        s.add_argument("--top-k", type=int, default=10)
    c = sub.add_parser("compare")
    c.add_argument("--results", required=True)
    c.add_argument("--manifest", required=True)
    c.add_argument("--allow-config-diff", action="store_true")
    c.add_argument("--out", required=True)
    return p.parse_args(argv)


def main(argv: list[str]) -> int:
    o = _options(argv)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    try:
        if o.what == "validate":
            _, facts = evaluate.validated(spark, o.exam, o.corpus, o.allow_corpus_drift)
            print(facts)
        elif o.what == "evaluate":
            if not (o.exam and o.responses and o.manifest and o.backend_profile and o.out):
                return 2
            t, _ = evaluate.validated(spark, o.exam, o.corpus, o.allow_corpus_drift)
            got = evaluate.evaluated(t, spark.read.schema(RESPONSES).json(o.responses), backends.load_profile(o.backend_profile), {"primary_k": o.primary_k, "eval_ks": o.eval_k}, check_names=not o.skip_name_check)
            evaluate.write_evaluation(got, spark.read.schema(MANIFEST).json(o.manifest), o.out)
        elif o.what == "compare":
            pairs, ranking, excluded = evaluate.compared_runs(runs.read_results(spark, o.results), spark.read.schema(MANIFEST).json(o.manifest), o.allow_config_diff)
            text = runs.comparison_report([r.asDict() for r in pairs.orderBy("metric", "left_run", "right_run").collect()], [r[0] for r in excluded.orderBy("question_id").collect()], comparing.notes(spark.read.schema(MANIFEST).json(o.manifest)))
            runs.export(pairs, f"{o.out}/pairs")
            runs.export(ranking, f"{o.out}/ranking")
            spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{o.out}/report")
        elif o.what == "build":
            ledger, docs = spark.read.schema(building.LEDGER).json(o.ledger, multiLine=True), corpus.read_files(spark, o.corpus)
            places = building.resolved(ledger, docs)
            building.check_resolved(places)
            runs.export(building.built(ledger, places, docs), o.out)
        else:
            t, docs = read_exam(spark, o.exam), corpus.read_files(spark, o.corpus)
            building.screen(t, docs, o.window, o.overlap, o.top_k).orderBy(F.desc("trivial"), "question_id").show(1000, truncate=False)
    except evaluate.DocumentNameMismatch as e:
        print(f"document names don't match: {e}", file=sys.stderr)
        return 4
    except (OptionError, backends.ProfileError) as e:
        print(e, file=sys.stderr)
        return 2
    except (evaluate.ExamValidationError, building.LedgerError, building.BuildError, comparing.ComparisonError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
