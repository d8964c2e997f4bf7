"""python tests/run_checks.py [sf] [--sql] [name-prefix ...]: compare registered queries with their SQL texts."""
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
import __spark_entry__ as entry  # noqa: E402
from oracle import compare, duck, session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
wanted = [a for a in sys.argv[2:] if a != "--sql"]
sql_only = "--sql" in sys.argv
spark = session()
sf_dir = f"/root/testdata/sf{sf}"
con = duck(sf_dir)
oracles = entry.oracle_sql()
bad = 0
t_all = time.time()
for name, fn in entry.queries().items():
    if sql_only and name not in oracles:
        continue
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    t0 = time.time()
    try:
        df = fn(spark, sf_dir)
        if name in oracles:
            problem = compare(df, con, oracles[name])
        else:
            n = len(df.collect())
            problem = None if n else "no rows"
    except Exception as e:  # noqa: BLE001
        problem = "".join(traceback.format_exception_only(e))[:1500]
        tb = traceback.extract_tb(e.__traceback__)
        problem += " | " + " <- ".join(f"{f.name}:{f.lineno}" for f in tb[-6:] if "helioscape" in f.filename or "checks" in f.filename)
    bad += problem is not None
    mark = "ok  " if problem is None else "FAIL"
    kind = "" if name in oracles else " (rows only)"
    print(f"{mark} {name}{kind} {time.time() - t0:.2f}s {problem or ''}"[:1800], flush=True)
print(f"{bad} failing, {time.time() - t_all:.0f}s")
