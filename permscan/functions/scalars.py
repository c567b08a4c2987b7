"""Column expressions of the data model; all stay inside the JVM."""

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NULL_TOKENS

# Spark's cast also takes '1d', '1.5f' and hex floats, hence the pattern. It knows infinity in these spellings.
NUMBER = r"^\s*[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
MISSING = "^(" + "|".join(re.escape(token) for token in NULL_TOKENS) + ")$"


def trait_number(text: Column) -> Column:
    """Text as double; anything that is not a number becomes NULL."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def number(text: Column) -> Column:
    """Result value: parsed as double, then narrowed to 32 bits."""
    return trait_number(text).cast("float")


def is_malformed(text: Column, parsed: Column) -> Column:
    """Text that gave no number although it does not spell a missing one."""
    return parsed.isNull() & text.isNotNull() & ~F.trim(text).rlike(MISSING)


def decoded(uri: Column) -> Column:
    """File path from the percent-encoded form Spark reports."""
    return F.when(uri.contains("%"), F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))).otherwise(uri)


def source_name(uri: Column) -> Column:
    """Name of a run from its file: the ``source_file=`` folder if there is one, else the file stem."""
    plain = decoded(uri)
    folder = F.regexp_extract(plain, r"/source_file=([^/]+)/[^/]*$", 1)
    file = F.substring_index(plain, "/", -1)
    suffix = F.concat(F.lit("."), F.substring_index(file, ".", -1))
    stem = F.substring(file, F.lit(1), F.length(file) - F.length(suffix))
    return F.when(plain.contains("/source_file="), folder).otherwise(stem)


def perm_id(source: Column) -> Column:
    """Trailing number of a run name, NULL without one."""
    return F.regexp_extract(source, r"([0-9]+)$", 1).try_cast("int")


def perm_name(index: Column, prefix: str = "perm", width: int = 4) -> Column:
    """``perm_0042``; longer numbers keep all their digits."""
    return F.format_string(f"{prefix}_%0{width}d", index)


def variant_stem(path: Column | str) -> Column:
    """File name up to its first dot."""
    return F.substring_index(F.regexp_extract(path, r"([^/\\]+)$", 1), ".", 1)


def job_name(trait: Column, variant_type: Column) -> Column:
    return F.concat_ws("_", trait, variant_type)


def flags(notes: Column) -> Column:
    """Quality flags of a row as an array."""
    return F.filter(F.transform(F.split(notes, ","), F.trim), lambda flag: flag != "")


def effect_z(beta: Column, std_err: Column) -> Column:
    """Effect size over its standard error; NULL for a zero error."""
    return F.try_divide(beta.cast("double"), std_err.cast("double"))


def three_digits(value: Column) -> Column:
    """Number as result files print it: three significant digits, empty when not finite."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, F.format_string("%.2E", value)).otherwise(F.lit(""))


def rows_as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*(columns or ("*",))), {"ignoreNullFields": "false"})


# Coefficients of Cody's rational approximations of erf and erfc (Mathematics of Computation 23, 1969),
# for arguments up to 0.46875, up to 4 and above; numerators and denominators, highest power first.
ERF_SMALL = (
    [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3],
    [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3],
)
ERFC_MIDDLE = (
    [
        2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
        8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
    ],
    [
        1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
        3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
    ],
)
ERFC_LARGE = (
    [
        1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
        1.60837851487422766e-2, 6.58749161529837803e-4,
    ],
    [
        1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2,
        2.33520497626869185e-3,
    ],
)


def _polynomial(coefficients: list[float], x: Column) -> Column:
    value = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        value = value * x + F.lit(coefficient)
    return value


def _ratio(pair: tuple, x: Column) -> Column:
    return _polynomial(pair[0], x) / _polynomial(pair[1], x)


def chi2_tail(statistic: Column | str) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom: erfc(sqrt(x / 2)), full double precision.

    Negative statistics count as 0, NULL stays NULL.
    """
    statistic = F.col(statistic) if isinstance(statistic, str) else statistic
    square = F.greatest(statistic, F.lit(0.0)) / 2
    y = F.sqrt(square)
    small = 1 - y * _ratio(ERF_SMALL, square)
    middle = F.exp(-square) * _ratio(ERFC_MIDDLE, y)
    inverse = F.try_divide(F.lit(1.0), square)
    large = F.try_divide(F.exp(-square) * (F.lit(1 / math.sqrt(math.pi)) - inverse * _ratio(ERFC_LARGE, inverse)), y)
    return F.when(statistic.isNotNull(), F.when(y <= 0.46875, small).when(y <= 4, middle).otherwise(large))
