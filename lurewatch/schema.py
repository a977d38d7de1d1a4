"""Row shapes shared by all jobs."""

RAW_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"

ANCHOR = "struct<visible_text:string,href:string>"
FILE = "struct<filename:string,content_type:string,size_bytes:bigint,sha256:string>"
HOP = "struct<from_host:string,by_host:string,timestamp:string,raw:string>"

FINDING = (
    "struct<title:string,category:string,severity:string,description:string,"
    "evidence:string,recommendation:string,location:string,confidence:double,"
    "tags:array<string>>"
)
