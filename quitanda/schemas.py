"""Schemas of the raw inputs and messages."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, StringType, StructField, StructType

CUSTOMER = (
    "id string, cpf string, nome string, email string, telefone string, data_nascimento string, "
    "data_cadastro string, cidade string, uf string, estado string, cep string, "
    "segmento_cliente string, limite_credito string, ativo string"
)
SALE_COLUMNS = (
    "id_venda", "id_pedido", "cpf_cliente", "data_venda", "data_entrega", "data_cancelamento",
    "produto_id", "produto_nome", "categoria_produto", "quantidade", "valor_unitario", "desconto",
    "valor_total", "custo", "canal_venda", "status_venda", "forma_pagamento", "parcelas",
    "vendedor_id", "loja_id",
)
CLICK = (
    "_id string, event_type string, timestamp string, user_id string, session_id string, "
    "page struct<url:string,path:string,title:string,referrer:string>, "
    "device struct<type:string,browser:string,os:string,screen_width:int,screen_height:int>, "
    "location struct<country:string,city:string,timezone:string>, "
    "utm struct<source:string,medium:string,campaign:string>, "
    "properties struct<tempo_pagina_ms:int,scroll_depth_pct:int,produto_id:string>"
)
PURCHASE = (
    "id_venda string, cpf_cliente string, produto struct<id:string,nome:string,categoria:string>, "
    "quantidade int, valor_unitario double, desconto double, valor_total double, "
    "forma_pagamento string, parcelas int, canal string, cidade string"
)
EVENT = f"{CLICK}, {PURCHASE}"
SALE_MESSAGE = (
    "id_venda string, cpf_cliente string, valor_total double, data_venda string, "
    "canal_venda string, produto_id string, quantidade int, "
    "_metadata struct<fonte:string,versao_schema:string>"
)
SALE_MESSAGE_REQUIRED = ("id_venda", "cpf_cliente", "valor_total", "data_venda")


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def all_strings(names) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def customer_document() -> StructType:
    """One JSON document: flat customer, or an envelope holding a list of them."""
    one = struct(CUSTOMER)
    many = ArrayType(one)
    return StructType([
        StructField("clientes", many), StructField("data", many), *one.fields,
        StructField("_corrupt_record", StringType()),
    ])
