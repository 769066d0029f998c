"""Schemas of the delimited inputs and the rename map of the credit table."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the input files, in file order where the file has no header.
CREDIT_RENAMES = {
    "rev_util": "uso_de_credito",
    "age": "edad",
    "debt_ratio": "radio_deuda",
    "real_estate": "num_otros_prestamos",
    "dependents": "num_dependientes",
    "late_30_59": "atraso_30_59",
    "late_60_89": "atraso_60_89",
    "late_90": "atraso_90",
    "monthly_inc": "ingreso_mensual",
    "open_credit": "cuentas_abiertas",
    "dlq_2yr": "delincuencia_reciente",
}
MOVIE_COLUMNS = [
    "movie_id", "movie_title", "release_date", "video_release_date", "IMDb_URL",
    "unknown", "Action", "Adventure", "Animation", "Children", "Comedy", "Crime",
    "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror", "Musical", "Mystery",
    "Romance", "Sci-Fi", "Thriller", "War", "Western",
]

_INT, _STR, _DBL = T.IntegerType(), T.StringType(), T.DoubleType()


def schema_of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


CREDIT = schema_of(
    rev_util=_DBL, age=_INT, late_30_59=_INT, debt_ratio=_DBL, monthly_inc=_DBL, open_credit=_INT,
    late_90=_INT, real_estate=_INT, late_60_89=_INT, dependents=_INT, dlq_2yr=_INT,
)
RATINGS = schema_of(userid=_INT, itemid=_INT, rate=_INT, timestamp=T.LongType())
USERS = schema_of(userid=_INT, age=_INT, gender=_STR, occupation=_STR, zcode=_STR)
MOVIES = T.StructType(
    [T.StructField(c, _INT if i == 0 or i >= 5 else _STR) for i, c in enumerate(MOVIE_COLUMNS)]
)
