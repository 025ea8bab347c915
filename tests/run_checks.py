"""Compare all (or the named) queries with their SQL: python tests/run_checks.py [folder] [name ...]"""

import os
import sys
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, connect  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from keepsake.session import local_session  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = local_session(8)
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
runs, sqls = queries(), oracle_sql()
names = sys.argv[2:] or list(runs)
bad = 0
for name in names:
    try:
        note, n, ours, theirs = compare(spark, con, name, runs[name], sqls.get(name), folder)
    except Exception as problem:
        note, n, ours, theirs = f"{type(problem).__name__}: {str(problem)[:1200]}", -1, 0, 0
        if len(names) < 4:
            traceback.print_exc()
    bad += note is not None
    print(f"{'ok ' if note is None else 'BAD'} {name:32s} rows={n:7d} spark={ours:6.2f}s duckdb={theirs:6.2f}s"
          f"{'' if name in sqls else ' (no sql)'}{'' if note is None else chr(10) + '    ' + note}", flush=True)
print(f"{len(names)} queries, {bad} bad")
