"""Closed document schemas, always passed explicitly when JSON is read."""

POINT = "struct<x:int,y:int>"
SIZE = "struct<width:int,height:int>"
PALETTE_V2 = "struct<rgba:array<array<int>>,sha256:string,snapperPaletteHex:array<string>>"
TRACK = "struct<id:string,kind:string,required:boolean,attachTo:string>"
SOCKET = "struct<id:string,trackId:string,required:boolean>"
CONTACT = "struct<id:string,trackId:string,kind:string,required:boolean>"
REVIEW = "struct<checkpoints:array<string>,approvers:array<string>>"

FRAME_V1 = f"struct<id:string,pose:string,duration:int,landmarkSemantic:struct<name:string,target:{POINT}>>"
CLIP_V1 = (
    "struct<id:string,loopMode:string,loopTransition:struct<fromFrameId:string,toFrameId:string,reviewCheckpoint:string>,"
    f"frames:array<{FRAME_V1}>>"
)
CONTRACT_V1 = (
    "struct<version:int,anchor:struct<sha256:string,traitReferenceSha256:array<string>>,"
    "sizes:struct<canonical:array<int>,generation:array<int>,runtime:array<int>,pixelSize:int>,"
    f"pivot:{POINT},baseline:int,palette:{PALETTE_V2},clips:array<{CLIP_V1}>,review:{REVIEW}>"
)

FRAME_V2 = (
    "struct<id:string,semantic:string,duration:int,tracks:array<string>,sockets:array<string>,"
    f"contacts:array<string>,groundTravel:{POINT}>"
)
CLIP_V2 = f"struct<id:string,loopMode:string,frames:array<{FRAME_V2}>>"
CONTRACT_V2 = (
    "struct<version:int,selectionApprovalSha256:string,character:struct<id:string,anchorSha256:string>,"
    f"canvas:struct<width:int,height:int,pivot:{POINT},baseline:int>,scale:struct<integer:int,runtime:{SIZE}>,"
    f"palette:{PALETTE_V2},tracks:array<{TRACK}>,sockets:array<{SOCKET}>,contacts:array<{CONTACT}>,"
    f"clips:array<{CLIP_V2}>,review:{REVIEW}>"
)

PROJECT = (
    "struct<schemaVersion:int,id:string,"
    "character:struct<name:string,identity:string,logicalHeight:int,anchors:array<struct<id:string,role:string,path:string,sha256:string>>>,"
    f"canvas:struct<width:int,height:int,pivot:{POINT},baseline:int>,scale:struct<integer:int,runtime:{SIZE}>,"
    "palette:struct<rgba:array<array<int>>,sha256:string>,"
    f"tracks:array<{TRACK}>,sockets:array<{SOCKET}>,contacts:array<{CONTACT}>,"
    "sources:struct<allowedKinds:array<string>,defaultStillKind:string>,"
    "actions:array<struct<id:string,semantic:string,loopMode:string,poses:array<string>,tracks:array<string>,"
    "sockets:array<string>,contacts:array<string>,sources:struct<preferred:string,fallbacks:array<string>>>>,"
    "engineTargets:array<struct<id:string,kind:string,version:string>>,"
    "approvals:struct<status:string,identities:array<string>,requiredGates:array<string>>>"
)

RECOVERY = (
    "struct<schemaVersion:int,background:struct<mode:string,rgba:array<int>,tolerance:int,spill:struct<minimumDominance:int>>,"
    "connectivity:int,minimumComponentPixels:int,maxDecodedRgbaBytes:bigint,padding:int,"
    "expectedCandidates:struct<min:int,max:int>,allowUnassigned:boolean,"
    "groups:array<struct<id:string,componentIds:array<string>>>>"
)

SEQUENCE = "struct<schemaVersion:int,frames:array<struct<id:string,path:string,durationMs:int>>>"
