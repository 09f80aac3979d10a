"""Arrival validation: columns per dataset, field rules per row, verdict per file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quitanda.functions.money import MONEY, parse_money


@dataclass(frozen=True)
class Spec:
    required: tuple[str, ...]
    expected: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    min_length: tuple[tuple[str, int], ...] = ()
    min_value: tuple[tuple[str, str], ...] = ()


# The arrival contract of each dataset.
SPECS = {
    "clientes": Spec(
        required=("cpf", "nome"),
        expected=("cpf", "nome", "email", "telefone", "cidade", "uf", "data_cadastro"),
        not_null=("cpf", "nome"), min_length=(("cpf", 11), ("nome", 3))),
    "vendas": Spec(
        required=("id_venda", "cpf_cliente", "valor_total", "data_venda"),
        expected=("id_venda", "cpf_cliente", "valor_total", "data_venda", "produto_nome",
                  "quantidade", "canal_venda"),
        not_null=("valor_total",), min_value=(("valor_total", "0.01"),)),
    "eventos": Spec(
        required=("_id", "event_type", "timestamp"),
        expected=("_id", "event_type", "timestamp", "user_id", "session_id")),
}


def dataset_of(path: Column) -> Column:
    """Dataset named by a path component, null when none is known."""
    found = F.regexp_extract(path, f"(?:^|/)({'|'.join(SPECS)})(?:/|$)", 1)
    return F.nullif(found, F.lit(""))


def column_report(df: DataFrame, spec: Spec) -> dict[str, list[str]]:
    """Missing required, missing expected and extra columns (case-insensitive), from the schema."""
    have = {c.lower() for c in df.columns}
    expected = {c.lower() for c in spec.expected}
    return {
        "obrigatorias_ausentes": [c for c in spec.required if c.lower() not in have],
        "esperadas_ausentes": [c for c in spec.expected if c.lower() not in have],
        "extras": [c for c in df.columns if c.lower() not in expected and not c.startswith("_")],
    }


def row_errors(df: DataFrame, spec: Spec) -> Column:
    """Error codes of a row."""
    tests = [F.when(F.col(c).isNull(), f"nulo:{c}") for c in spec.not_null if c in df.columns]
    for c, low in spec.min_value:
        if c in df.columns:
            number = parse_money(F.col(c).cast("string"))
            enough = F.coalesce(number >= F.lit(low).cast(MONEY), F.lit(False))
            tests.append(F.when(F.col(c).isNotNull() & ~enough, f"minimo:{c}"))
    return F.filter(F.array(*tests), lambda e: e.isNotNull()) if tests else F.array().cast("array<string>")


def row_warnings(df: DataFrame, spec: Spec) -> Column:
    tests = [F.when(F.length(c) < n, f"curto:{c}") for c, n in spec.min_length if c in df.columns]
    return F.filter(F.array(*tests), lambda e: e.isNotNull()) if tests else F.array().cast("array<string>")


def with_findings(df: DataFrame, spec: Spec) -> DataFrame:
    return df.withColumns({"erros": row_errors(df, spec), "avisos": row_warnings(df, spec)})


def validate_files(df: DataFrame, spec: Spec, file: str = "_source_file",
                   files: DataFrame | None = None) -> DataFrame:
    """Verdict per file over all of its rows.

    ``files`` (one row per arrived file, column ``file``) adds those that gave no row: an empty or
    unreadable file is invalid too.
    """
    missing = column_report(df, spec)["obrigatorias_ausentes"]
    found = with_findings(df, spec)
    bad = F.size("erros") > 0
    per_file = found.groupBy(file).agg(
        F.count("*").alias("total_registros"), F.count_if(bad).alias("registros_invalidos"),
        F.sum(F.size("erros")).cast("bigint").alias("erros"),
        F.sum(F.size("avisos")).cast("bigint").alias("avisos"))
    if files is not None:
        counts = ["total_registros", "registros_invalidos", "erros", "avisos"]
        per_file = files.select(file).join(per_file, file, "left").na.fill(0, counts)
    return per_file.withColumns({
        "colunas_ausentes": F.lit(",".join(missing)),
        "valido": (F.col("erros") == 0) & (F.col("total_registros") > 0) & F.lit(not missing),
    })


def verdict_totals(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count("*").alias("total_arquivos"), F.count_if("valido").alias("validos"),
        F.count_if(~F.col("valido")).alias("invalidos"),
        F.when(F.bool_and("valido"), 200).otherwise(400).alias("codigo"))
