"""Record schemas. Optional fields are null where a producer leaves them out."""

from __future__ import annotations

#: Any line of a capture; ``event_type`` or the presence of op and trace_id tells which kind.
CAPTURE = """
    event_type string, user_data decimal(20,0), tid bigint, pid bigint, opcode int, op_name string,
    nsid int, slba bigint, nlb bigint, bytes bigint, data_len bigint, hwq int, cid int,
    ts double, ts_start double, status int, lat_ns bigint, monotonic_ns bigint, realtime_ns bigint,
    dropped bigint, trace_id bigint, op string, key string, key_hex string, object_id string,
    part string, slot_offset bigint, error string, instance string, schema int, hostname string,
    header_bytes bigint, block_align bigint, shape array<int>, dtype string,
    components struct<k_bytes:bigint,v_bytes:bigint,scale_bytes:bigint>
"""

#: Integer-nanosecond device records.
DEVICE = """
    event_type string, user_data decimal(20,0), tid bigint, op_name string, slba bigint,
    bytes bigint, ts bigint, lat_ns bigint, status int, dropped bigint, trace_id bigint, op string
"""

GEOMETRY = """
    lbs bigint, iu_size bigint, npwg bigint, npwa bigint, npdg bigint, awun bigint, awupf bigint,
    nand_page bigint, device_name string
"""

SYSCALL_DOCUMENT = """
    metadata struct<duration_sec:double>,
    raw_events array<struct<timestamp_ns:bigint,pid:bigint,process_name:string,syscall_nr:int,
      syscall_name:string,fd:bigint,size:bigint,offset:bigint,filename:string,ret:bigint>>
"""

_SIDE = """struct<iops:double,bw:double,io_bytes:bigint,
    lat_ns:struct<mean:double,min:double,max:double,percentile:map<string,double>>>"""

BENCHMARK = f"""
    jobs array<struct<jobname:string,iodepth:int,`job options`:struct<bs:string>,
      read:{_SIDE},write:{_SIDE}>>
"""

PAGE_MONITOR = """
    mode string, pid bigint, start string, `end` string, pages_per_block int,
    snapshots array<struct<iter:bigint,ts_ms:bigint,total_dirty:bigint,blocks:array<int>>>
"""

MANIFEST = """
    device_geometry struct<engine:string,mdts_bytes:bigint,block_align:bigint,header_bytes:bigint,
      slot_bytes:bigint>,
    objects array<struct<index:bigint,part:string,payload_bytes:bigint,ops:array<string>>>
"""

#: What a workload says it has done, one ring request per line.
GROUND_TRUTH = """
    user_data decimal(20,0), op_name string, offset bigint, requested_bytes bigint, ddir string, cqe_res bigint, iov_sizes array<bigint>
"""
