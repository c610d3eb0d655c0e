import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    out = e.entry(spark)
    assert out.columns == ["cell", "total_reads", "exonic_reads", "enrichment"] and out.count() > 0


def test_sql_belongs_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


def test_library_does_not_import_the_corpus_operators():
    code = "import sys, strandlake.plans.catalog, strandlake.sources.binary, strandlake.sources.writers, strandlake.streaming.chunks; assert not [m for m in sys.modules if m.startswith('strandlake.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for p in (ROOT / "strandlake").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['strandlake.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
