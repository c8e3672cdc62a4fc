"""Types of parsed documents."""

PERSON = "struct<name:string,firstName:string,lastName:string,prefix:string,suffix:string,initial:string>"
FIELD = f"struct<pos:int,name:string,mode:string,value:string,list:array<string>,people:array<{PERSON}>>"
ENTRY = f"struct<ord:int,type:string,key:string,input:string,fields:array<{FIELD}>>"
ERROR = "struct<error:string,input:string>"
DOCUMENT = f"doc_id string, comments array<string>, preamble array<string>, strings map<string,string>, errors array<{ERROR}>, jabref array<string>, fatal string, entries array<{ENTRY}>"
CHUNK = "doc_id string, ord int, kind string, type string, key string, raw string, raw_fields array<struct<pos:int,name:string,parts:array<struct<kind:string,text:string>>>>"
FIELD_ROW = f"doc_id string, ord int, type string, key string, pos int, name string, mode string, value string, list array<string>, people array<{PERSON}>"
