"""Row types of the relations, named as the operators use them."""

from __future__ import annotations

LINK = "struct<lemma:string,target:string,begin:int,end:int>"
LINKS = f"sentence string, links array<{LINK}>"
PAGES = "title string, ns bigint, redirect string, text string"
REDIRECTS = "source string, destination string"
SENSE_COUNTS = "lemma string, target string, cnt bigint"
SENSES = "lemma string, total bigint, num_senses bigint, targets array<struct<target:string,cnt:bigint>>"
WORDS = "word string, cnt bigint"
MENTIONS = "link_text string, target string, sentence string"
TOKEN = "struct<begin:int,end:int,text:string,pos:string,lemma:string>"
DEPENDENCY = "struct<gov:int,dep:int,type:string,begin:int,end:int>"
FEATURE = "struct<key:string,values:array<string>,relation:string,hole:int>"
TRIPLE = "struct<subject:string,predicate:string,object:string>"
CLUSTERS = "word string, cluster_id string, features map<string,float>"
