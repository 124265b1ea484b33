"""From cells to validated observations, for many files in one run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrid.operators import blocks as b
from tallgrid.operators import extract, harmonize, mapping, profile
from tallgrid.operators.profile import BLOCK
from tallgrid.session import cut


@dataclass(frozen=True)
class Preview:
    """Blocks with their facts, mapped columns and tall values of a set of files."""
    blocks: DataFrame
    columns: DataFrame
    values: DataFrame


def preview(cells: DataFrame, sheets: DataFrame) -> Preview:
    """Block detection, table extraction, profiling and classification."""
    found = cut(b.detect_blocks(cells, sheets))
    described, columns, values = extract.extract_tables(found, b.block_cells(found, b.present(cells)))
    mapped = cut(profile.profile_columns(values, columns, described))
    classified = described.join(profile.classify_blocks(mapped), BLOCK)
    return Preview(classified, mapped, values)


def edit(shown: Preview, edits: DataFrame | None = None, year_overrides: DataFrame | None = None) -> Preview:
    """User edits and year overrides on top of a preview, with mapping defaults filled in."""
    columns = shown.columns if edits is None else mapping.apply_edits(shown.columns, edits)
    blocks = shown.blocks if year_overrides is None else mapping.apply_year_override(shown.blocks, year_overrides)
    return Preview(blocks, mapping.mapping_defaults(columns), shown.values)


def violations(shown: Preview) -> DataFrame:
    """Everything that forbids a commit: mapping rules, missing years and years out of range."""
    none = F.lit(None).cast("string").alias("column")
    years = mapping.lint_year(shown.columns, shown.blocks).select("*", none)
    ranges = mapping.lint_year_range(shown.blocks).select(*BLOCK, none, F.lit("year_out_of_range").alias("violation"))
    return mapping.lint_mapping(shown.columns).unionByName(years).unionByName(ranges)


def commit(shown: Preview) -> DataFrame:
    """Staging observations of the uploads without violations; classification follows the edited mapping.

    An upload is refused as a whole: one violation keeps all of its blocks out.
    """
    refused = violations(shown).select("artifact_id").distinct()
    decided = profile.classify_blocks(shown.columns).select(*BLOCK, "commit_decision")
    blocks = (shown.blocks.drop("commit_decision").join(decided, BLOCK)
              .join(refused, "artifact_id", "left_anti"))
    built = harmonize.build_observations(shown.values, shown.columns, blocks)
    return harmonize.validate_observations(built)
