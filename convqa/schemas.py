"""Declared schemas of the file forms; scans never infer."""

QUESTION = (
    "id string, pair_id string, language string, topic string, sub_topic string, question string, expected_answer string, "
    "source_chunks array<string>, chunk_ids array<string>, audio_file string, original_question_id string, arabic_counterpart string"
)
CHUNK = "id string, text string"
MESSAGE = "struct<turn:int,question_id:string,question:string,expected_answer:string,audio_file:string>"
SESSION = f"session_id string, subtopic string, language string, agent_id string, turns int, messages array<{MESSAGE}>"
STEP = "struct<step_n:int,stimulus:string,expected_answer:string,chunk_ids:array<string>>"
SCENARIO = (
    "struct<id:string,flow_id:string,pair_id:string,mode:string,language:string,question:string,expected_answer:string,"
    f"steps:array<{STEP}>,chunk_ids:array<string>,sub_topic:string,topic:string>"
)
FLOW_STEP = "flow_id string, spoken string, mode string, step_n bigint, language string, question string, expected_answer string, chunk_ids array<string>"
FLOW_SPEC = f"flow_id string, title string, topic string, chunks array<struct<id:string,text:string>>, flows array<{SCENARIO}>"
TURN = (
    "struct<speaker:string,role:string,type:string,text:string,message:string,content:string,transcript:string,"
    "start:double,startTime:double,start_time:double,end:double,endTime:double,end_time:double,is_interrupted:boolean>"
)
CONVERSATION = (
    f"id string, status string, duration double, createdAt string, callStartedAt string, recording_url string, agentId string, "
    f"transcription array<{TURN}>, metadata struct<participant:struct<ani:string>>"
)
CHECK = (
    "struct<clip:string,responded:boolean,latencyMs:double,clipMs:double,responseSignal:string,latencyMsToFirstAudioChunk:double,"
    "answerText:string,error:string>"
)
TURN_SOURCE = (
    "struct<turn:int,question_id:string,file_ids:array<string>,fileIds:array<string>,loaded_files:array<string>,"
    "loadedFiles:array<string>,play_id:string,playId:string,source_keys:array<string>,saw_source_frame:boolean>"
)
SUMMARY = (
    f"passed boolean, reason string, agentId string, conversationId string, env struct<appUrl:string>, checks array<{CHECK}>, "
    f"liveTranscript array<struct<speaker:string,text:string>>, transcript struct<turns:array<struct<speaker:string,text:string>>>, "
    f"sourceFilesByTurn array<{TURN_SOURCE}>"
)
RESPONSES = (
    "conversationId string, source string, exchanges array<struct<ours:string,reply:string>>, "
    "replies array<struct<clip:string,responded:boolean,latencyMs:double,latencyMsToFirstAudioChunk:double,signal:string>>"
)
RESULT = (
    "struct<session_id:string,language:string,agent_id:string,turns:int,passed:boolean,reason:string,replies:int,wallMs:bigint,"
    "conversationId:string,callUrl:string>"
)
RUN_REPORT = f"stamp string, startedAt string, sessions int, passed int, failed int, wallMs bigint, results array<{RESULT}>"
FRAME = "session_id string, ts timestamp, kind string, raw string"

# Fixed column order of the talk-over report.
INTERRUPTION_COLUMNS = (
    "file", "duration_s", "is_bug", "confidence", "longest_overlap_s", "total_overlap_s", "overlap_segment_count", "longest_overlap_start_s",
    "error", "phone_number", "exchange_count", "failed_high", "failed_low", "interruptions_handled",
)
