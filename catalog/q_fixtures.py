from pyspark.sql import functions as F
from catalog.core import query

for name in ["points","truth","frames","boxes","corrs","pixels","hsv","sigs","decided","views","labels","yards","paths"]:
    query("fx_"+name, f"select * from fx_{name}")(lambda t, n=name: getattr(t, n))
