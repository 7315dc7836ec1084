"""Row types of documents in structure; readers use these, never inference."""

from __future__ import annotations

ITEM = "struct<type:string,text:string,bbox:array<double>,font:string,size:double,flags:int,color:array<double>,isBoldLike:boolean,isItalicLike:boolean,isMonospaceLike:boolean,isSerifLike:boolean,isSuperscriptLike:boolean,isSubscriptLike:boolean>"
LINE = f"struct<bbox:array<double>,items:array<{ITEM}>>"
BLOCK = (
    "struct<id:string,page:int,pageWidth:double,pageHeight:double,bbox:array<double>,text:string,translatedText:string,fontSize:double,rotation:int,role:string,"
    "blockType:string,doclingLabel:string,layoutIntent:string,renderPolicy:string,preserveOriginal:boolean,preserveReason:string,isBodyLike:boolean,"
    f"demotedFromHeading:boolean,translationMetaNote:string,layoutLines:array<{LINE}>>"
)
PAYLOAD = f"struct<version:int,sourceFile:string,title:string,blocks:array<{BLOCK}>,pages:array<struct<page:int,blocks:array<{BLOCK}>>>,pageLineHints:map<string,array<array<double>>>>"
CUE = "struct<id:string,sequence:int,cueIdentifier:string,start:string,end:string,settings:string,sourceText:string,translatedText:string>"
CHAPTER = "struct<id:string,ord:int,href:string,mediaType:string,entryName:string,title:string,html:string,isTOC:boolean>"
