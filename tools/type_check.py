"""Compare Spark result types with DuckDB result types for every query (sf0.001)."""
import sys
import os; sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from quire import get_spark
from quire.plans import QUERIES, ORACLE
from tools.oracle_check import duck
spark=get_spark("local[4]",8)
con=duck('/root/testdata/sf0.001')
SPARK2DUCK={"IntegerType()":"INTEGER","LongType()":"BIGINT","DoubleType()":"DOUBLE","StringType()":"VARCHAR",
            "BooleanType()":"BOOLEAN","FloatType()":"FLOAT","ShortType()":"SMALLINT","ByteType()":"TINYINT"}
for n,fn in QUERIES.items():
    sql=ORACLE.get(n)
    if sql is None: continue
    df=fn(spark,'/root/testdata/sf0.001')
    st={f.name: SPARK2DUCK.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    rel=con.sql(sql)
    dt={c: str(t) for c,t in zip(rel.columns, rel.types)}
    bad={c:(st.get(c),dt.get(c)) for c in set(st)|set(dt) if st.get(c)!=dt.get(c)}
    if bad: print(n, bad)
print("done")
