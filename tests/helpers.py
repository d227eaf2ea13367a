from concordat.operators.compare import reconcile
from concordat.spec import Normalization, ReconSpec


def table(spark, names, rows):
    columns = names.split()
    full = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "_n long, " + ", ".join(f"`{c}` string" for c in columns))


def request(keys_a, keys_b=None, values_a="", values_b=None, **more):
    split = lambda s: tuple(s.split())
    rules = Normalization(**more.pop("rules", {}))
    keys_b = keys_a if keys_b is None else keys_b
    values_b = values_a if values_b is None else values_b
    return ReconSpec(split(keys_a), split(keys_b), split(values_a), split(values_b), normalization=rules, order_a=("_n",), order_b=("_n",), **more)


def outcome(a, b, spec):
    """(type, key) in result order."""
    return [(r["result_type"], tuple(r["key"])) for r in reconcile(a, b, spec).ordered.collect()]
