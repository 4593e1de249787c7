"""Schemas of the robot bus messages, and scans of topics with them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fields of the typed messages. Unsigned types widen to the next signed one.
_FIELDS = {
    "Time": "sec int, nanosec long",
    "Duration": "sec int, nanosec long",
    "Header": "stamp Time, frame_id string",
    "ColorRGBA": "r float, g float, b float, a float",
    "String": "data string",
    "Point": "x double, y double, z double",
    "Point32": "x float, y float, z float",
    "Quaternion": "x double, y double, z double, w double",
    "Pose": "position Point, orientation Quaternion",
    "PoseStamped": "header Header, pose Pose",
    "PoseWithCovariance": "pose Pose, covariance double[]",
    "PoseWithCovarianceStamped": "header Header, pose PoseWithCovariance",
    "Vector3": "x double, y double, z double",
    "Twist": "linear Vector3, angular Vector3",
    "TwistWithCovariance": "twist Twist, covariance double[]",
    "TwistWithCovarianceStamped": "header Header, twist TwistWithCovariance",
    "Accel": "linear Vector3, angular Vector3",
    "AccelWithCovariance": "accel Accel, covariance double[]",
    "AccelWithCovarianceStamped": "header Header, accel AccelWithCovariance",
    "RegionOfInterest": "x_offset long, y_offset long, height long, width long, do_rectify boolean",
    "CameraInfo": "header Header, height long, width long, distortion_model string, d double[], k double[], r double[], "
    "p double[], binning_x long, binning_y long, roi RegionOfInterest",
    "Image": "header Header, height long, width long, encoding string, is_bigendian short, step long, data binary",
    "IMU": "header Header, orientation Quaternion, orientation_covariance double[], angular_velocity Vector3, "
    "angular_velocity_covariance double[], linear_acceleration Vector3, linear_acceleration_covariance double[]",
    "Detection": "header Header, orientation Quaternion, orientation_covariance double[], angular_velocity Vector3, "
    "angular_velocity_covariance double[], linear_acceleration Vector3, linear_acceleration_covariance double[]",
    "HazardDetection": "header Header, type short",
    "HazardDetectionVector": "header Header, detections HazardDetection[]",
    "NavSatStatus": "status byte, service int",
    "NavSatFix": "header Header, status NavSatStatus, latitude double, longitude double, altitude double, "
    "position_covariance double[], position_covariance_type short",
    "PointField": "name string, offset long, datatype short, count long",
    "PointCloud": "header Header, points Point32[], channels PointField[]",
    "PointCloud2": "header Header, height long, width long, fields PointField[], is_bigendian boolean, point_step long, "
    "row_step long, data binary, is_dense boolean",
    "BatteryState": "header Header, voltage float, temperature float, current float, charge float, capacity float, "
    "design_capacity float, percentage float, power_supply_status short, power_supply_health short, "
    "power_supply_technology short, present boolean, cell_voltage float[], cell_temperature float[], location string, "
    "serial_number String",
    "LaserScan": "header Header, angle_min float, angle_max float, angle_increment float, time_increment float, "
    "scan_time float, range_min float, range_max float, ranges float[], intensities float[]",
    "DockStatus": "header Header, docker_visible boolean, is_docked boolean",
    "Paths": "header Header, paths long[], blocked_by_obstacle_idx long[], blocked_by_hazard_idx long[]",
    "AudioStatus": "header Header, status_mic byte, status_speaker byte, sentence_to_speak String",
    "CameraStatus": "header Header, status byte",
    "MotionStatus": "header Header, control byte, attitude byte, state byte",
}

_SIMPLE = {
    "string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(),
    "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "binary": T.BinaryType(),
}

MESSAGES = tuple(_FIELDS)


def _type(name: str) -> T.DataType:
    if name.endswith("[]"):
        return T.ArrayType(_type(name[:-2]))
    return _SIMPLE[name] if name in _SIMPLE else message_schema(name)


def message_schema(name: str) -> T.StructType:
    """The Spark type of a message."""
    pairs = (field.split(" ") for field in re.split(r",\s*", _FIELDS[name]))
    return T.StructType([T.StructField(field, _type(kind)) for field, kind in pairs])


def read_topic(spark: SparkSession, path: str, message: str, streaming: bool = False, form: str = "parquet") -> DataFrame:
    """A topic's messages with their fixed schema, as a table or a stream; nothing is inferred.

    A path without files gives an empty table.
    """
    reader = spark.readStream if streaming else spark.read
    return reader.schema(message_schema(message)).format(form).load(path)
