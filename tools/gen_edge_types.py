"""Regenerate ledgerlens/plans/edge_types.py from the registered queries' schemas
(run after adding or changing a query: python tools/gen_edge_types.py)."""

import os
import sys
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from ledgerlens.plans import catalog
from ledgerlens.session import build_session
from pyspark.sql import types as T
spark = build_session()
catalog.load_all()
dec, dat = {}, {}
for name in sorted(catalog.QUERIES):
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    d1 = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    d2 = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
    nested = [f.name for f in df.schema.fields if ("decimal" in f.dataType.simpleString() or "date" in f.dataType.simpleString())
              and not isinstance(f.dataType, (T.DecimalType, T.DateType))]
    if nested:
        print("NESTED", name, nested)
    if d1: dec[name] = d1
    if d2: dat[name] = d2
lines = ['"""Result columns of the registered queries whose type is changed at the',
         'driver edge (generated by tools/gen_edge_types.py; the oracle test checks',
         'the map is complete): exact decimals become doubles, dates become ISO',
         '``yyyy-MM-dd`` text."""', "",
         "DECIMAL_RESULT_COLUMNS = {"]
lines += [f"    {k!r}: {v!r}," for k, v in dec.items()] + ["}", "", "DATE_RESULT_COLUMNS = {"]
lines += [f"    {k!r}: {v!r}," for k, v in dat.items()] + ["}"]
open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "ledgerlens/plans/edge_types.py"), "w").write("\n".join(lines) + "\n")
print(len(dec), len(dat))
