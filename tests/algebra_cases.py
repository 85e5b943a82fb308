"""What the tests of the algebra share."""


def rows(rel):
    """Rows as sorted tuples, with exact numbers as floats."""
    import decimal

    plain = lambda v: float(v) if isinstance(v, decimal.Decimal) else v
    df = rel if hasattr(rel, "collect") else rel.df
    return sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
