"""python tests/run_oracles.py SF_DIR [NAME...]: every query against its SQL, with times."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402

import __spark_entry__ as e  # noqa: E402
from placeloom.session import build_session  # noqa: E402

spark = build_session("8", 8, "8g")
spark.sparkContext.setLogLevel("ERROR")
con = oracle.connect(sys.argv[1])
q, sql = e.queries(), e.oracle_sql()
bad = 0
for name in sys.argv[2:] or q:
    began = time.time()
    try:
        df = q[name](spark, sys.argv[1])
        said = oracle.compare(df, con, sql[name]) if name in sql else f"rows {df.count()}"
    except Exception as x:  # noqa: BLE001
        said = "ERROR " + str(x)[:600]
    good = said == "" or said.startswith("rows")
    bad += not good
    print(f"{'ok ' if good else 'BAD'} {name} {time.time() - began:.1f}s {said}", flush=True)
print(f"{bad} bad")
