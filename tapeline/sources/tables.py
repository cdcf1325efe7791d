"""Table readers with explicit column lists, so the scan reads what a query needs."""


def table(spark, sf_dir, name, *cols):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df
