"""Terms of the data model and their accepted spellings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings, which results depend on.
MODALITIES = {
    "h&e": "he",
    "h_e": "he",
    "h-e": "he",
    "he": "he",
    "brightfield": "he",
    "comet": "comet",
    "lunaphorecomet": "comet",
    "cosmx": "cosmx",
    "cosmxsmi": "cosmx",
    "nanostringcosmx": "cosmx",
    "brukercosmx": "cosmx",
}
ROLES = (
    "brightfield_red",
    "brightfield_green",
    "brightfield_blue",
    "nuclear",
    "autofluorescence",
    "membrane",
    "cytoplasm",
    "immune",
    "marker",
    "morphology",
    "unknown",
)
ROLE_ALIASES = {
    "red": "brightfield_red",
    "green": "brightfield_green",
    "blue": "brightfield_blue",
    "dapi": "nuclear",
    "hoechst": "nuclear",
    "nucleus": "nuclear",
    "af": "autofluorescence",
    "autofluorescence_tritc": "autofluorescence",
    "autofluorescence_cy5": "autofluorescence",
    "broad_membrane_or_tissue": "membrane",
}
ARTIFACTS = ("fold", "crack", "hard_negative")
ARTIFACT_ALIASES = {"tear": "crack", "crack_tear": "crack", "crack/tear": "crack", "folding": "fold", "hardnegative": "hard_negative"}


def lookup(value: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[value]


def modality(value: Column) -> Column:
    """The modality of a spelling; null if unknown."""
    return lookup(F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("")), MODALITIES)


def channel_role(value: Column) -> Column:
    """The role of a spelling; ``unknown`` if unknown."""
    term = F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("_"))
    return F.coalesce(lookup(term, ROLE_ALIASES), F.when(term.isin(*ROLES), term), F.lit("unknown"))


def artifact(value: Column) -> Column:
    """The artifact kind of a spelling; null if unknown."""
    term = F.translate(F.lower(F.trim(value)), "- ", "__")
    return F.coalesce(lookup(term, ARTIFACT_ALIASES), F.when(term.isin(*ARTIFACTS), term))


def normal_name(value: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")


def normal_term(value: Column) -> Column:
    """Lower case, with underscores for spaces and hyphens."""
    return F.translate(F.lower(F.trim(value)), "- ", "__")


def required(value: Column, what: str) -> Column:
    """The value; an error where it is null."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"{what} is not accepted")))


# Parts of normal channel names, in the order in which they are tried, by modality.
COMET_ROLES = (
    ("nuclear", ("dapi", "hoechst", "nuclear", "nucleus")),
    ("autofluorescence", ("^af", "autofluorescence", "autofluor", "background")),
    ("membrane", ("membrane", "wga", "cd298", "b2m")),
    ("cytoplasm", ("pankeratin", "pancytokeratin", "panck", "cytoplasm")),
    ("marker", ("fitc", "tritc", "cy3", "cy5", "cy7", "alexa")),
)
COSMX_ROLES = (
    ("nuclear", ("dapi", "hoechst", "nuclear", "nucleus")),
    ("membrane", ("cd298", "b2m", "membrane", "wga", "epcam")),
    ("cytoplasm", ("panck", "pankeratin", "pancytokeratin", "cytokeratin")),
    ("immune", ("cd45", "immune", "leukocyte")),
    ("autofluorescence", ("^af", "autofluor")),
)


def role_of_channel(name: Column, modality: str) -> Column:
    """The role of a channel name of a fluorescence modality: of the first rule that fits, else marker or morphology."""
    compact = normal_name(name)
    out = F.lit("marker" if modality == "comet" else "morphology")
    for role, terms in reversed(COMET_ROLES if modality == "comet" else COSMX_ROLES):
        out = F.when(compact.rlike("|".join(terms)), role).otherwise(out)
    return out


#: Roles that show structure, in the order of a structural view; markers and unknown channels never do.
STRUCTURAL = ("nuclear", "autofluorescence", "membrane", "cytoplasm", "immune", "morphology")


def channel_axis(shape: Column, axis: Column, names: Column) -> Column:
    """The axis of the channels of a three-dimensional shape (0 to 2); null for two dimensions, an error otherwise.

    A given axis counts, from the end if negative; else one as long as there are channel ``names`` (of several the last, else
    the first); without names the first, if it alone is short (64 at most) and shorter than the others; else the last.
    """
    same = F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get(shape, i) == names)
    named = F.when(F.size(same) == 0, F.raise_error(F.lit("no axis has as many channels as there are names")).cast("int"))
    named = named.when(F.size(same) == 1, F.get(same, F.lit(0))).when(F.array_contains(same, 2), 2).otherwise(F.get(same, F.lit(0)))
    short = lambda i, j, k: (F.get(shape, F.lit(i)) <= 64) & (F.get(shape, F.lit(i)) < F.least(F.get(shape, F.lit(j)), F.get(shape, F.lit(k))))
    guess = F.when(short(0, 1, 2) & ~short(2, 0, 1), 0).otherwise(2)
    given = F.when((axis < -3) | (axis > 2), F.raise_error(F.lit("a channel axis lies between -3 and 2")).cast("int")).otherwise(F.pmod(axis, F.lit(3)))
    three = F.when(axis.isNotNull(), given).when(F.coalesce(names, F.lit(0)) > 0, named).otherwise(guess)
    return F.when(F.size(shape) == 2, F.lit(None).cast("int")).when(F.size(shape) == 3, three.cast("int")).otherwise(F.raise_error(F.lit("an image has two or three dimensions")).cast("int"))


def bright_channels(values: Column, order: str = "rgb") -> Column:
    """Channels of a bright-field image as red, green, blue: four lose the last (alpha), ``bgr`` is turned, one stays; else an error."""
    colours = F.slice(values, 1, 3)
    turned = F.reverse(colours) if order == "bgr" else colours
    return F.when(F.size(values) == 1, values).when(F.size(values).isin(3, 4), turned).otherwise(F.raise_error(F.lit("a bright-field image has 1, 3 or 4 channels")).cast("array<double>"))
