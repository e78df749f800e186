"""Schemas of the rows that pass between stages."""

METADATA = (
    "struct<title:string,type:string,correspondent:string,tags:array<string>,document_date:date,due_date:date,"
    "reference:string,description:string,amount:string,currency:string,filename:string>"
)
TRUNCATION = "struct<pages_processed:int,pages_total:int>"
ARCHIVE = "struct<attempted:boolean,success:boolean,exit_code:int,output:string,error:string,attempted_at:timestamp>"
SCAN = "path string, mime string, size long, digest string, ext string, content binary"

#: How each kind of failure ends a run.
EXIT_CODES = {
    "source": 2,
    "unsupported": 2,
    "missing-tool": 2,
    "not-configured": 2,
    "bomb": 2,
    "schema-unsupported": 2,
    "usage": 2,
    "empty": 1,
    "extract": 1,
    "transport": 1,
    "rejected": 1,
    "no-rule": 1,
    "path": 1,
    "claim": 1,
    "archive": 1,
    "trace": 1,
}
