"""The public functions as SQL functions of a session: `register(spark)`, then use them in any query.

Scalar ones are SQL expressions, which Catalyst takes into the query that calls them. `alignment_events` is a table
function over whole Arrow batches: `alignment_events(TABLE(SELECT cigar, md, read FROM ...))`, with ref_start where
alignments don't begin at place 0. Its rows may be dealt over any number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import batch as kernel
from . import dna

#: name(arguments), type and body of each scalar function.
SCALARS = {
    "dna_gc(seq STRING)": ("BIGINT", "cast(length(regexp_replace(seq, '[^GC]', '')) AS BIGINT)"),
    "dna_gc_share(seq STRING)": ("DOUBLE", "try_divide(length(regexp_replace(seq, '[^GC]', '')), length(seq))"),
    "dna_longest_run(seq STRING)": ("BIGINT", "cast(coalesce(array_max(transform(regexp_extract_all(seq, 'A+|C+|G+|T+', 0), r -> length(r))), 0) AS BIGINT)"),
    "dna_longest_frame(seq STRING)": ("BIGINT", f"cast(coalesce(array_max(transform(regexp_extract_all(seq, 'ATG{dna.NO_STOP}*{dna.STOP}', 0), r -> length(r))), 0) AS BIGINT)"),
    "dna_other_strand(seq STRING)": ("STRING", "reverse(translate(seq, 'ACGT', 'TGCA'))"),
    "dna_six_encode(block STRING)": ("STRING", f"translate(lpad(conv(block, 16, 6), {dna.SIX_LETTERS}, '0'), '012345', '{dna.SIX}')"),
    "dna_six_decode(seq STRING)": ("STRING", f"lower(lpad(conv(translate(seq, '{dna.SIX}', '012345'), 6, 16), {2 * dna.SIX_BYTES}, '0'))"),
}


class AlignmentEvents:
    """A row for each substituted, inserted or deleted base: `number` of the alignment in its batch, kind, pos, bases."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        found = kernel.alignment_events(rows)
        yield pa.table({"number": pa.array(found["row"], pa.int64()), "kind": kernel.single_letters(found["kind"]), "pos": pa.array(found["pos"], pa.int32()), "ref_base": kernel.single_letters(found["ref"]), "read_base": kernel.single_letters(found["read"])})


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; gives their names."""
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    table = F.arrow_udtf(AlignmentEvents, returnType="number long, kind string, pos int, ref_base string, read_base string")
    spark.udtf.register("alignment_events", table)
    return [h.partition("(")[0] for h in SCALARS] + ["alignment_events"]
