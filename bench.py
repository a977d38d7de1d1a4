"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to its last row and column (written to Spark's `noop` sink)
after one untimed run, so what is timed is the job and not the start of the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lurewatch.plans import catalog  # noqa: E402
from lurewatch.session import local_session  # noqa: E402

HEADLINES = [
    "corpus_scan",
    "mail_parse",
    "findings_all",
    "analysis_result",
    "link_parts",
    "dom_brand_match",
    "txt_signals",
    "att_extensions",
    "auth_spf",
    "report_markdown",
    "intel_domain_join",
    "quiz_score",
    "redact_secrets",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "lurewatch-bench")
    queries = catalog.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINES:
        run(name)
        seconds[name] = round(run(name), 3)
    mails = catalog.table(spark, folder, "documents").count()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "mails": mails,
                "mails_per_second": {
                    n: round(mails / seconds[n]) for n in ("corpus_scan", "mail_parse", "analysis_result")
                },
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
